"""Money impact of anomalies and the ranked outputs built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.config import MONEY_METRIC, PERIOD, SERIES_KEY, DetectorParams
from weftmark.functions.numbers import fixed, half_up, ratio, thousands
from weftmark.operators.explain import latest_period
from weftmark.operators.profile import union_all

# Metric -> action, category, owner.
ACTIONS = {
    "VIEWS": (
        "Investigate traffic sources, paid acquisition efficiency, and channel mix",
        "Traffic & Acquisition",
        "Growth / Marketing",
    ),
    "CLICKS": (
        "Investigate traffic sources, paid acquisition efficiency, and channel mix",
        "Traffic & Acquisition",
        "Growth / Marketing",
    ),
    "COMPLETES": (
        "Audit donation flow conversion, checkout UX, and payment failures",
        "Donor Conversion",
        "Product / Engineering",
    ),
    "GDV": (
        "Decompose into donation volume vs average gift; check segment contributions",
        "Revenue",
        "CFO / FP&A",
    ),
    "NAC2": (
        "Review fundraiser quality, onboarding flow, and early donor activation",
        "Fundraiser Quality",
        "Product / Growth",
    ),
    "FUNDRAISERS": (
        "Analyze publish funnels by country, device, and traffic source",
        "Supply",
        "Growth / Product",
    ),
    "COST": (
        "Review paid marketing efficiency, CPC trends, and ROAS by channel",
        "Marketing Efficiency",
        "Marketing",
    ),
}
DEFAULT_ACTION = ("Investigate root cause at source table level", "General", "Data / Analytics")
NO_ACTION = "No action required — all metrics normal."
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
STATUS = {"CRITICAL": "🔴 CRITICAL", "HIGH": "🟡 WARNING", "MEDIUM": "🟢 MONITOR"}
HEALTHY = "✅ HEALTHY"
VIEW_VALUE, CLICK_VALUE = 0.01, 0.05


def proxy_ratios(facts: DataFrame) -> DataFrame:
    """Per source the mean over periods of money per complete and money per fundraiser."""
    weekly = facts.groupBy("source_table", PERIOD).agg(
        *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("gdv", "completes", "fundraisers")]
    )
    return weekly.groupBy("source_table").agg(
        F.avg(ratio(F.col("gdv"), F.col("completes"))).alias("gift_ratio"),
        F.avg(ratio(F.col("gdv"), F.col("fundraisers"))).alias("fund_ratio"),
    )


def financial_impact(
    summary: DataFrame, ratios: DataFrame, params: DetectorParams = DetectorParams()
) -> DataFrame:
    """Weekly and yearly money value of material anomalies.

    ``ratios`` has one row per source; the summary one per series and period.
    """
    moved = summary.where(
        (F.col("direction") != "NORMAL")
        & (F.col("severity") != "LOW")
        & F.col("pct_diff").isNotNull()
        & F.col("actual").isNotNull()
        & F.col("baseline_avg").isNotNull()
    )
    valued = moved.join(ratios, "source_table", "left")

    def positive(column: str) -> Column:
        return F.when(F.col(column) > 0, F.col(column)).otherwise(1.0)

    metric = F.col("metric")
    factor = (
        F.when(metric.isin(MONEY_METRIC, "COST"), 1.0)
        .when(metric == "COMPLETES", positive("gift_ratio"))
        .when(metric == "FUNDRAISERS", positive("fund_ratio"))
        .when(metric == "VIEWS", VIEW_VALUE)
        .when(metric == "CLICKS", CLICK_VALUE)
        .otherwise(0.0)
    )
    valued = valued.withColumn("weekly_dollar_impact", (F.col("actual") - F.col("baseline_avg")) * factor)
    valued = valued.where(F.abs("weekly_dollar_impact") >= params.weekly_impact_floor)
    yearly = F.col("weekly_dollar_impact") * 52
    named = valued.select(
        "source_table",
        PERIOD,
        "metric",
        F.when(metric == "COST", F.concat(F.lit("COST_"), F.col("direction")))
        .otherwise(F.col("direction"))
        .alias("direction"),
        "severity",
        "pct_diff",
        "weekly_dollar_impact",
        yearly.alias("annualized_dollar_impact"),
        (yearly / params.annual_target * 100).alias("annualized_pct_of_target"),
    )
    text = F.format_string(
        "%s: $%s/week ($%s/year annualized, %s%% of target). Movement: %s%% (%s).",
        F.when(metric == MONEY_METRIC, "Revenue impact").otherwise("Estimated proxy impact"),
        thousands(F.abs("weekly_dollar_impact")),
        thousands(F.abs("annualized_dollar_impact")),
        fixed(F.abs("annualized_pct_of_target"), 1),
        fixed(F.col("pct_diff"), 1),
        F.lower("direction"),
    )
    return named.withColumn("narrative", text)


def _count(name: str) -> Column:
    return F.count_if(F.col("severity") == name)


def traffic_light(summary: DataFrame, impacts: DataFrame) -> DataFrame:
    """One row: status of the latest period and the summed yearly exposure of all impacts."""
    exposure = impacts.agg(F.coalesce(F.sum("annualized_dollar_impact"), F.lit(0.0))).scalar()
    latest = summary.where(F.col(PERIOD) == latest_period(summary))
    counted = latest.agg(
        F.max(PERIOD).alias("reporting_week"),
        _count("CRITICAL").alias("critical_issues"),
        _count("HIGH").alias("high_issues"),
        _count("MEDIUM").alias("medium_issues"),
        F.count_if(F.col("direction") != "NORMAL").alias("total_anomalies"),
    )
    status = (
        F.when(F.col("critical_issues") > 0, STATUS["CRITICAL"])
        .when(F.col("high_issues") > 0, STATUS["HIGH"])
        .when(F.col("medium_issues") > 0, STATUS["MEDIUM"])
        .otherwise(HEALTHY)
    )
    return counted.where(F.col("reporting_week").isNotNull()).select(
        status.alias("overall_status"), "*", exposure.alias("annualized_financial_exposure")
    )


def traffic_light_items(summary: DataFrame) -> DataFrame:
    """The critical and high series of the latest period."""
    latest = summary.where(
        (F.col(PERIOD) == latest_period(summary)) & F.col("severity").isin("CRITICAL", "HIGH")
    )
    return latest.select(
        "metric",
        "source_table",
        half_up(F.col("pct_diff"), 1).alias("pct_change"),
        "severity",
        F.when(F.col("severity") == "CRITICAL", half_up(F.col("z_score"), 2)).alias("z_score"),
    )


def _lookup(part: int) -> Column:
    metric, chosen = F.col("metric"), F.lit(DEFAULT_ACTION[part])
    for name, row in ACTIONS.items():
        chosen = F.when(metric == name, row[part]).otherwise(chosen)
    return chosen


def action_items(summary: DataFrame, impacts: DataFrame) -> DataFrame:
    """Abnormal series of the latest period with action, owner and value, by severity and then money.

    The value is that of the series' earliest impact row. Without an anomaly there is one "none" row.
    """
    first = impacts.groupBy(*SERIES_KEY).agg(
        F.min_by("annualized_dollar_impact", PERIOD).alias("financial_annualized")
    )
    latest = summary.where(F.col(PERIOD) == latest_period(summary))
    joined = latest.where(F.col("direction") != "NORMAL").join(first, list(SERIES_KEY), "left")
    value = F.coalesce("financial_annualized", F.lit(0.0))
    expected = F.concat(F.lit("$"), thousands(F.abs(value)), F.lit("/yr"))
    items = joined.select(
        F.col("severity").alias("priority"),
        "metric",
        "source_table",
        half_up(F.col("pct_diff"), 1).alias("pct_change"),
        "direction",
        _lookup(0).alias("action"),
        F.when(value != 0, expected).otherwise("Unquantified").alias("expected_impact"),
        value.alias("financial_annualized"),
        _lookup(1).alias("category"),
        _lookup(2).alias("owner"),
        F.when(F.col("severity").isin("CRITICAL", "HIGH"), "This week").otherwise("Normal cadence").alias("urgency"),
        half_up(F.col("consensus_strength"), 2).alias("consensus_strength"),
    )
    calm = latest.agg(F.count_if(F.col("direction") != "NORMAL").alias("n"), F.count("*").alias("rows"))
    none = calm.where("n = 0 AND rows > 0").select(
        F.lit("LOW").alias("priority"),
        F.lit("—").alias("metric"),
        F.lit("—").alias("source_table"),
        F.lit(0.0).alias("pct_change"),
        F.lit("NORMAL").alias("direction"),
        F.lit(NO_ACTION).alias("action"),
        F.lit("$0").alias("expected_impact"),
        F.lit(0.0).alias("financial_annualized"),
        F.lit("General").alias("category"),
        F.lit("Monitor").alias("owner"),
        F.lit("None").alias("urgency"),
        F.lit(0.0).alias("consensus_strength"),
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("priority"))
    return items.unionByName(none).orderBy(
        rank, F.col("financial_annualized").desc(), "source_table", "metric"
    )


def executive_brief_facts(
    summary: DataFrame, impacts: DataFrame, decomposed: DataFrame, warnings: DataFrame,
    params: DetectorParams = DetectorParams(),
) -> DataFrame:
    """The brief as text lines (section, order_key, text).

    Sections keep the order of the printed brief; inside a section lines follow source and metric.
    """
    newest = latest_period(summary)
    latest = summary.where(F.col(PERIOD) == newest)

    def line(section: int, df: DataFrame, text: Column, *order: str) -> DataFrame:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in order]) if order else F.lit("")
        return df.select(F.lit(section).alias("section"), key.alias("order_key"), text.alias("text"))

    money_rows = latest.where(F.col("metric") == MONEY_METRIC)
    head = money_rows.agg(
        F.min_by(
            F.struct("direction", "pct_diff", "z_score", "severity", "source_table"),
            F.struct(F.coalesce("pct_diff", F.lit(float("inf"))), "source_table"),
        ).alias("h")
    )
    top = F.format_string(
        "TOP-LINE: GDV %s of %s%% (z=%s, severity=%s) Source: %s",
        "h.direction", fixed(F.col("h.pct_diff"), 1), fixed(F.col("h.z_score"), 1), "h.severity", "h.source_table",
    )
    sections = [
        line(1, latest.agg(F.max(PERIOD).alias("w")), F.concat(F.lit("Week Ending: "), F.col("w").cast("string"))),
        line(2, head, F.when(F.col("h").isNotNull(), top).otherwise("TOP-LINE: GDV within normal range.")),
        line(
            3,
            decomposed.where(F.col(PERIOD) == newest),
            F.concat(F.lit("DECOMP: "), F.col("decomposition_narrative")),
            "source_table",
        ),
    ]
    for number, name in ((4, "CRITICAL"), (5, "HIGH")):
        text = F.format_string(
            f"{name}: %s.%s: %s%% (%s)", "source_table", "metric", fixed(F.col("pct_diff"), 1), "direction"
        )
        sections.append(line(number, latest.where(F.col("severity") == name), text, *SERIES_KEY))
    sums = impacts.agg(
        F.sum("weekly_dollar_impact").alias("week"), F.sum("annualized_dollar_impact").alias("year")
    ).where("week IS NOT NULL")
    impact_text = F.format_string(
        "FINANCIAL IMPACT: weekly $%s (%s), annualized $%s (%s), %s%% of annual target",
        thousands(F.abs("week")),
        F.when(F.col("week") > 0, "favorable").otherwise("unfavorable"),
        thousands(F.abs("year")),
        F.when(F.col("year") > 0, "opportunity").otherwise("exposure"),
        fixed(F.abs("year") / params.annual_target * 100, 1),
    )
    sections.append(line(6, sums, impact_text))
    sections.append(line(7, warnings, F.col("narrative"), "predictor_metric", "target_metric", "lag_weeks"))
    signals = latest.agg(_count("CRITICAL").alias("c"), _count("HIGH").alias("h"), _count("MEDIUM").alias("m"))
    sections.append(
        line(8, signals, F.format_string("%d critical, %d high, %d medium signals detected", "c", "h", "m"))
    )
    covered = summary.agg(F.countDistinct(PERIOD).alias("w"), F.countDistinct("source_table").alias("s"))
    sections.append(
        line(9, covered, F.format_string("Data spans %d weeks across %d source tables", "w", "s"))
    )
    return union_all(sections)
