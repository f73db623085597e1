"""Weekly facts: one row per source, period and dimensions with seven metrics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.config import DIMENSIONS, METRICS, PERIOD
from weftmark.operators.clean import orders_clean, safe_number_sum, safe_timestamp
from weftmark.operators.gate import ROLE_KEYWORDS, pick_role
from weftmark.operators.marts import week_of
from weftmark.operators.profile import union_all

# rows that a task of the distinct count or of a join before it holds, about, and least rows of a task where there are few
TASK_ROWS = 1 << 19
SMALL_ROWS = 1 << 16


@dataclass(frozen=True)
class Roles:
    """Which column of a source serves which role; None means the source has none."""

    date: str | None = None
    fundraiser: str | None = None
    country: str | None = None
    device: str | None = None
    source: str | None = None
    gdv: str | None = None
    nac2: str | None = None
    complete: str | None = None
    view: str | None = None
    click: str | None = None
    cost: str | None = None

    @classmethod
    def discover(cls, df: DataFrame, keywords=ROLE_KEYWORDS) -> Roles:
        return cls(**{role: pick_role(df.schema, role, keywords) for role in keywords})


def count_or_sum(df: DataFrame, column: str | None) -> Column:
    if column is None:
        return F.lit(None).cast("double")
    if df.schema[column].dataType.typeName() in ("string", "date", "timestamp", "timestamp_ntz", "boolean"):
        return F.count(column)
    return F.sum(column)


def within(df: DataFrame, column: str, until: str | None, lookback_weeks: int | None) -> Column:
    """Whether a date column has a value inside [until - lookback, until).

    The bounds take the type of the column, so that on a stored date or timestamp they reach the scan.
    """
    kind = df.schema[column].dataType.typeName()
    native = kind in ("date", "timestamp", "timestamp_ntz")
    value, kind = (F.col(column), kind) if native else (safe_timestamp(df, column), "timestamp")
    inside = value.isNotNull()
    if until is not None:
        end = F.lit(until).cast("date")
        inside = inside & (value < end.cast(kind))
        if lookback_weeks is not None:
            inside = inside & (value >= F.date_sub(end, 7 * lookback_weeks).cast(kind))
    return inside


def deal_by_fundraiser(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Rows dealt by fundraiser to as many tasks as ``size``, their number or more, asks for.

    Spark's tasks follow compressed bytes, of which facts take few, and a task's fundraisers of every period and dimension stand
    in memory until they are counted. Dealt like this, a join on the fundraiser and the distinct count behind it shuffle no more.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-size // TASK_ROWS), min(tasks, size // SMALL_ROWS)), column)


def deal_where_many(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Rows ahead of a join on ``column``, dealt by it where ``size``, their number or more, asks for more tasks than Spark's.

    The join's sort would else hold more in a task the more rows there are. Fewer rows are left to Spark, which may broadcast the
    other side instead.
    """
    tasks = -(-size // TASK_ROWS)
    return rows.repartition(tasks, column) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _aggregate(df: DataFrame, rows: DataFrame, moment: Column, source: Column, roles: Roles, period: str) -> DataFrame:
    def dimension(column: str | None, name: str) -> Column:
        return (F.lit(None) if column is None else F.col(column)).cast("string").alias(name)

    def optional(column: str | None, build) -> Column:
        return F.lit(None).cast("double") if column is None else build(column)

    measures = {
        "fundraisers": optional(roles.fundraiser, F.countDistinct),
        "gdv": optional(roles.gdv, lambda c: safe_number_sum(df, c)),
        "nac2": optional(roles.nac2, F.count),
        "completes": optional(roles.complete, F.count),
        "views": count_or_sum(df, roles.view),
        "clicks": count_or_sum(df, roles.click),
        "cost": optional(roles.cost, lambda c: safe_number_sum(df, c)),
    }
    start_of = week_of(moment) if period == "week" else F.to_date(F.date_trunc(period, moment))
    dims = [
        dimension(roles.country, "country"),
        dimension(roles.device, "device"),
        dimension(roles.source, "traffic_source"),
    ]
    return (
        rows.groupBy(source.alias("source_table"), start_of.alias(PERIOD), *dims)
        .agg(*[m.cast("double").alias(name) for name, m in measures.items()])
        .select("source_table", PERIOD, *DIMENSIONS, *measures)
    )


def weekly_facts(
    df: DataFrame,
    source: str,
    roles: Roles,
    *,
    until: str | None = None,
    lookback_weeks: int | None = None,
    period: str = "week",
) -> DataFrame | None:
    """Aggregate one source; None for a source without a date column.

    ``until`` (exclusive, a date) and ``lookback_weeks`` bound the rows; "today" is never read from the clock.
    """
    if roles.date is None:
        return None
    rows = df.where(within(df, roles.date, until, lookback_weeks))
    return _aggregate(df, rows, safe_timestamp(df, roles.date), F.lit(source), roles, period)


def weekly_facts_by_dates(
    df: DataFrame,
    dates: Mapping[str, str],
    roles: Roles,
    *,
    until: str | None = None,
    lookback_weeks: int | None = None,
    period: str = "week",
) -> DataFrame:
    """Several sources that read the same rows by different date columns (source name -> column).

    The rows, and any join behind them, are computed once: each row is dated once per source and then meets
    the map-side aggregation directly.
    """
    dated = F.array(
        *[
            F.struct(
                F.lit(source).alias("_source"),
                F.when(within(df, column, until, lookback_weeks), safe_timestamp(df, column)).alias("_moment"),
            )
            for source, column in dates.items()
        ]
    )
    rows = df.select("*", F.inline(dated)).where(F.col("_moment").isNotNull())
    return _aggregate(df, rows, F.col("_moment"), F.col("_source"), roles, period)


def weekly_facts_union(parts: list[DataFrame | None]) -> DataFrame:
    """All sources appended; those without a date column are left out."""
    present = [p for p in parts if p is not None]
    if not present:
        raise ValueError("no source has a date column")
    return union_all(present)


def weekly_channel_facts(orders: DataFrame) -> DataFrame:
    """Valid orders by week and channel, in the shape of the facts (two metrics only)."""
    return (
        orders_clean(orders)
        .groupBy(week_of(F.col("order_date")).alias(PERIOD), F.col("channel").alias("device"))
        .agg(F.sum("revenue").cast("double").alias("gdv"), F.count("*").cast("double").alias("completes"))
        .select(
            F.lit("ORDERS").alias("source_table"),
            PERIOD,
            F.lit("ALL").alias("country"),
            "device",
            F.lit("ALL").alias("traffic_source"),
            "gdv",
            "completes",
        )
    )


def _present(facts: DataFrame) -> list[str]:
    have = {c.lower() for c in facts.columns}
    return [m for m in METRICS if m.lower() in have]


def _melt(df: DataFrame, ids: list[str]) -> DataFrame:
    """Wide to long over the metrics the frame has; a missing value counts as 0."""
    filled = [F.coalesce(F.col(m.lower()).cast("double"), F.lit(0.0)).alias(m) for m in _present(df)]
    return df.select(*ids, *filled).unpivot(ids, _present(df), "metric", "value")


def facts_long(facts: DataFrame) -> DataFrame:
    return _melt(facts, ["source_table", PERIOD, *DIMENSIONS])


def weekly_series(facts: DataFrame) -> DataFrame:
    """One value per source, metric and period.

    The dimensions are summed away while the metrics still stand side by side, so the shuffle moves one row
    per source and period instead of one per metric.
    """
    sums = [F.sum(m.lower()).alias(m.lower()) for m in _present(facts)]
    return _melt(facts.groupBy("source_table", PERIOD).agg(*sums), ["source_table", PERIOD])


def seed_periods(series: DataFrame, metric: str, factors: dict[str, float]) -> DataFrame:
    """Multiply one metric in given periods, to plant known anomalies."""
    scaled = F.col("value")
    for day, factor in factors.items():
        hit = (F.col("metric") == metric) & (F.col(PERIOD) == F.lit(day).cast("date"))
        scaled = F.when(hit, F.col("value") * factor).otherwise(scaled)
    return series.withColumn("value", scaled)
