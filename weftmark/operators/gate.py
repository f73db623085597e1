"""Column roles and the data quality gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructType, TimestampNTZType, TimestampType

from weftmark.config import DetectorParams
from weftmark.operators.profile import union_all

# Role -> keywords, best first.
ROLE_KEYWORDS = {
    "date": (
        "week_start", "report_week", "week", "event_date", "event_timestamp", "payment_created", "created",
        "timestamp", "date", "transaction_at", "report_date",
    ),
    "fundraiser": ("fundraiser_id", "views_fundraiser_id", "fundraiser"),
    "country": (
        "fundraiser_country_iso", "views_country_code", "landing_page_country_code", "campaign_country",
        "country_code", "country",
    ),
    "device": ("device_name", "device_type", "device_udid", "device"),
    "source": (
        "record_source", "platform_source", "utm_source", "campaign_source", "ea_source", "source", "channel",
    ),
    "gdv": (
        "net_gdv", "gross_gdv", "total_donation_amount", "donation_amount", "amount_raised", "goal_amount",
        "gdv", "amount",
    ),
    "nac2": ("nac2_count", "is_nac2", "nac2"),
    "complete": ("complete_users", "complete", "purchase", "num_donations", "donation_id"),
    "view": ("page_view", "is_fundraiser_page_view", "view_event", "views_event_id", "view"),
    "click": ("clicks", "donate_click", "click"),
    "cost": ("cost", "spend"),
}

Keywords = Mapping[str, tuple[str, ...]]


def pick_role(schema: StructType, role: str, keywords: Keywords = ROLE_KEYWORDS) -> str | None:
    """The column of a schema that serves a role: keyword order wins, then column order."""
    fields = schema.fields
    if role == "date":
        fields = [f for f in fields if isinstance(f.dataType, DateType | TimestampType | TimestampNTZType)]
    for word in keywords[role]:
        for f in fields:
            if word in f.name.lower():
                return f.name
    return fields[0].name if role == "date" and fields else None


def role_profile(catalog: DataFrame, keywords: Keywords = ROLE_KEYWORDS) -> DataFrame:
    """Best column per (table, role) of a column catalog, with the rows of its table.

    Keywords are a fixed list, so their rank is a column expression; no join is needed.
    """
    name = F.lower("column_name")
    is_date = F.col("data_type").startswith("date") | F.col("data_type").startswith("timestamp")

    def rank(role: str) -> Column:
        hits = [F.when(name.contains(word), F.lit(i)) for i, word in enumerate(keywords[role])]
        best = F.coalesce(*hits)
        if role == "date":
            best = F.when(is_date, F.coalesce(best, F.lit(len(hits))))
        return F.struct(F.lit(role).alias("role"), best.alias("rank"))

    ranked = catalog.select("table_name", "column_name", "position", "row_count", F.inline(F.array(*map(rank, keywords))))
    return (
        ranked.where("rank IS NOT NULL")
        .groupBy("table_name", "role")
        .agg(F.min_by("column_name", F.struct("rank", "position")).alias("column_name"), F.max("row_count").alias("row_count"))
    )


CHECKS = ("row_count", "null_fraction", "date_coverage", "metric_type")
_ISSUE_SCHEMA = "check string, table_name string, issue string, fatal boolean, unparsable bigint"


def _role_columns(schema: StructType, roles: tuple[str, ...], keywords: Keywords) -> dict[str, str]:
    picked = {role: pick_role(schema, role, keywords) for role in roles}
    return {role: column for role, column in picked.items() if column}


def _table_issues(
    df: DataFrame, table: str, params: DetectorParams, keywords: Keywords, checks: tuple[str, ...]
) -> DataFrame | None:
    """Issues of one table from one aggregate over it; None if no check looks at it."""
    measures: dict[str, Column] = {"n": F.count("*")}
    found: list[tuple[str, Column, Column, Column]] = []  # check, condition, text, unparsable values
    none = F.lit(None).cast("bigint")
    if "row_count" in checks:
        text = F.format_string(f"Table %s has only %d rows (min: {params.min_total_rows})", F.lit(table), "n")
        found.append(("row_count", F.col("n") < params.min_total_rows, text, none))
    if "null_fraction" in checks:
        for i, column in enumerate(sorted(set(_role_columns(df.schema, ("date", "gdv"), keywords).values()))):
            measures[f"nulls_{i}"] = F.count_if(F.col(column).isNull())
            share = F.col(f"nulls_{i}") / F.greatest(F.col("n"), F.lit(1))
            text = F.format_string(
                f"Table %s.%s is %d%% null (max: {params.max_null_fraction:.0%})".replace("%)", "%%)"),
                F.lit(table), F.lit(column), F.floor(share * 100 + 0.5),
            )
            found.append(("null_fraction", share > params.max_null_fraction, text, none))
    if "date_coverage" in checks:
        for column in _role_columns(df.schema, ("date",), keywords).values():
            measures["days"] = F.datediff(F.max(F.to_date(column)), F.min(F.to_date(column)))
            weeks = F.col("days") / 7.0
            text = F.format_string(
                f"Table %s.%s spans only %d weeks (expected ~{params.lookback_weeks})",
                F.lit(table), F.lit(column), F.floor(weeks + 0.5),
            )
            found.append(("date_coverage", weeks < params.lookback_weeks * 0.5, text, none))
    if "metric_type" in checks:
        for role, column in _role_columns(df.schema, ("gdv", "cost"), keywords).items():
            kind = df.schema[column].dataType
            if isinstance(kind, NumericType):
                continue
            value = F.col(column).cast("string")
            measures[f"lost_{role}"] = F.count_if(value.isNotNull() & value.try_cast("double").isNull())
            name = kind.simpleString().upper()
            text = F.lit(f"Table {table}.{column} ({role}) has type {name} — expected numeric; will use TRY_TO_NUMBER")
            found.append(("metric_type", F.lit(True), text, F.col(f"lost_{role}")))
    if not found:
        return None
    rows = [
        F.struct(
            cond.alias("hit"), F.lit(check).alias("check"), F.lit(table).alias("table_name"), text.alias("issue"),
            F.lit(False).alias("fatal"), lost.cast("bigint").alias("unparsable"),
        )
        for check, cond, text, lost in found
    ]
    measured = df.agg(*[m.alias(name) for name, m in measures.items()])
    return measured.select(F.inline(F.array(*rows))).where("hit").drop("hit")


def _issues(
    tables: Mapping[str, DataFrame | None], params: DetectorParams, keywords: Keywords, checks: tuple[str, ...]
) -> DataFrame:
    """Issues of all tables. A table given as None could not be read: an issue of its rows, but no failure."""
    readable = {name: df for name, df in tables.items() if df is not None}
    session = next(iter(readable.values())).sparkSession
    parts = [_table_issues(df, name, params, keywords, checks) for name, df in readable.items()]
    absent = [
        ("row_count", name, f"Table {name} does not exist or is not accessible — skipping", False, None)
        for name in tables
        if name not in readable and "row_count" in checks
    ]
    if absent or not any(p is not None for p in parts):
        parts.append(session.createDataFrame(absent, _ISSUE_SCHEMA))
    return union_all([p for p in parts if p is not None])


def gate_row_counts(tables: Mapping[str, DataFrame | None], params: DetectorParams = DetectorParams()) -> DataFrame:
    """Tables with too few rows."""
    return _issues(tables, params, ROLE_KEYWORDS, ("row_count",)).drop("unparsable")


def gate_null_fraction(
    tables: Mapping[str, DataFrame], params: DetectorParams = DetectorParams(), keywords: Keywords = ROLE_KEYWORDS
) -> DataFrame:
    """Date and money columns with too many nulls."""
    return _issues(tables, params, keywords, ("null_fraction",)).drop("unparsable")


def gate_date_coverage(
    tables: Mapping[str, DataFrame], params: DetectorParams = DetectorParams(), keywords: Keywords = ROLE_KEYWORDS
) -> DataFrame:
    """Date columns that span less than half of the lookback period."""
    return _issues(tables, params, keywords, ("date_coverage",)).drop("unparsable")


def gate_metric_types(tables: Mapping[str, DataFrame], keywords: Keywords = ROLE_KEYWORDS) -> DataFrame:
    """Money and cost columns that are not numeric.

    Each finding also carries how many values will be lost when the text is read as number.
    """
    return _issues(tables, DetectorParams(), keywords, ("metric_type",))


def quality_gate(
    tables: Mapping[str, DataFrame | None],
    params: DetectorParams = DetectorParams(),
    keywords: Keywords = ROLE_KEYWORDS,
) -> DataFrame:
    """All issues of the four checks, from one pass over each table.

    ``passed`` is false only where an issue is fatal, which none is.
    """
    return _issues(tables, params, keywords, CHECKS).drop("unparsable").withColumn("passed", ~F.col("fatal"))


def gate_passed(issues: DataFrame) -> DataFrame:
    """One row: number of issues and whether the gate lets the data through."""
    return issues.agg(
        F.count("*").alias("issues"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed")
    )
