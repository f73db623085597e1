"""Why a series moved: decomposition, segments, leading indicators and year-over-year change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.config import DIMENSIONS, MONEY_METRIC, PERIOD, SERIES_KEY, DetectorParams
from weftmark.functions.numbers import fixed, half_up, ratio, thousands
from weftmark.functions.ordering import sequence_numbers, top_by
from weftmark.functions.stats import student_two_sided_p
from weftmark.operators.facts import facts_long

# Texts.
IMMATERIAL = "Change below materiality threshold — no meaningful decomposition."
VOLUME = "volume (donation count)"
YIELD = "yield (average gift size)"
ALL_COUNTRIES, ALL_DEVICES, ALL_SOURCES = "Global", "All devices", "All sources"
NO_WARNING = "No leading indicator warnings detected."

# series of a block, about; blocks of targets meet blocks of predictors
BLOCK_SERIES = 64


def latest_period(summary: DataFrame) -> Column:
    """The newest period of a summary, as a scalar subquery."""
    return summary.agg(F.max(PERIOD)).scalar()


def decompose_volume_yield(facts: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Split the change of money per source and period into a volume and a yield effect.

    Volume plus yield is the change. Money and completes stand in the same fact row, so no join is needed.
    """
    weekly = facts.groupBy("source_table", PERIOD).agg(
        F.sum(F.coalesce("gdv", F.lit(0.0))).alias("gdv_current"),
        F.sum(F.coalesce("completes", F.lit(0.0))).alias("completes_current"),
    )
    prior = Window.partitionBy("source_table").orderBy(PERIOD).rowsBetween(-params.baseline_weeks, -1)

    def gift(money: str, count: str) -> Column:
        return F.when(F.col(count) > 0, F.col(money) / F.col(count)).otherwise(0.0)

    df = weekly.select(
        "*",
        F.avg("gdv_current").over(prior).alias("gdv_baseline_avg"),
        F.avg("completes_current").over(prior).alias("completes_baseline_avg"),
    )
    df = df.select(
        "*",
        (F.col("gdv_current") - F.col("gdv_baseline_avg")).alias("gdv_delta"),
        gift("gdv_current", "completes_current").alias("avg_gift_current"),
        gift("gdv_baseline_avg", "completes_baseline_avg").alias("avg_gift_baseline_avg"),
    )
    more = F.col("completes_current") - F.col("completes_baseline_avg")
    dearer = F.col("avg_gift_current") - F.col("avg_gift_baseline_avg")
    df = df.select(
        "*",
        (more * F.col("avg_gift_baseline_avg")).alias("volume_effect"),
        (F.col("completes_current") * dearer).alias("yield_effect"),
        (more * dearer).alias("interaction_effect"),
    )

    def share(effect: str) -> Column:
        # the first period has no change at all: its shares are undefined, not zero
        moved = F.col("gdv_delta") != 0
        return F.when(moved, ratio(F.col(effect), F.col("gdv_delta")) * 100).when(~moved, 0.0)

    return df.select(
        "*",
        share("volume_effect").alias("volume_pct_of_change"),
        share("yield_effect").alias("yield_pct_of_change"),
    )


def decomposition_narrative(decomposed: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """A sentence naming the larger effect, or a fixed text for immaterial changes."""
    volume, yields, delta = F.abs("volume_effect"), F.abs("yield_effect"), F.col("gdv_delta")
    by_volume = volume > yields
    text = F.format_string(
        "GDV %s of $%s driven primarily by %s ($%s vs $%s from %s). Average gift changed from $%s to $%s.",
        F.when(delta > 0, "increase").otherwise("decline"),
        thousands(F.abs(delta)),
        F.when(by_volume, VOLUME).otherwise(YIELD),
        thousands(volume),
        thousands(yields),
        F.when(by_volume, YIELD).otherwise(VOLUME),
        fixed(F.col("avg_gift_baseline_avg"), 2),
        fixed(F.col("avg_gift_current"), 2),
    )
    material = F.abs(delta) >= params.weekly_impact_floor
    return decomposed.withColumn("decomposition_narrative", F.when(material, text).otherwise(IMMATERIAL))


def segment_contributions(summary: DataFrame, facts: DataFrame) -> DataFrame:
    """Each segment's share of its series in the latest period.

    Series totals are a grouped sum joined back rather than a window, so that a source with very many
    segments is not sorted in one task.
    """
    latest = latest_period(summary)
    present = summary.where(F.col(PERIOD) == latest).select(*SERIES_KEY).distinct()
    segments = facts_long(facts.where(F.col(PERIOD) == latest)).join(present, list(SERIES_KEY), "left_semi")
    totals = segments.groupBy(*SERIES_KEY).agg(F.sum("value").alias("total"))
    share = F.when(F.col("total") > 0, F.col("value") / F.col("total") * 100).otherwise(0.0)
    return segments.join(totals, list(SERIES_KEY)).select(
        "source_table", PERIOD, "metric", *DIMENSIONS, "value", share.alias("share_of_total_pct")
    )


def segment_spotlight(contributions: DataFrame, n: int = 5) -> DataFrame:
    """The largest shares, empty dimensions spelled out."""

    def label(column: str, default: str) -> Column:
        return F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit(default)).alias(column)

    named = contributions.select(
        "metric",
        "source_table",
        label("country", ALL_COUNTRIES),
        label("device", ALL_DEVICES),
        label("traffic_source", ALL_SOURCES),
        half_up(F.col("share_of_total_pct"), 1).alias("share_of_total_pct"),
        F.round("share_of_total_pct", 9).alias("_exact"),
    )
    return top_by(named, F.col("_exact"), n, "source_table", "metric", *DIMENSIONS).drop("_exact")


# -- leading indicators -------------------------------------------------------------------------------------


def lagged_correlation(summary: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Correlation of every money series with every other series some periods earlier.

    The periods of all series form one axis; a period missing in a series counts as 0. Each series is one row with its
    values as an array, cut and centred once for each lag, and a pair of series is one row with a dot product. Both sides are
    dealt by hash to blocks whose number follows the number of series; a pair of blocks is one unit of work, so there are as many
    units as pairs of series ask for. What reads the pairs goes on in the same task: a filter, as for significant leads, comes before
    any shuffle.
    """
    axis = summary.agg(F.array_sort(F.collect_set(PERIOD))).scalar()
    by_period = F.map_from_entries(F.collect_list(F.struct(F.col(PERIOD), F.col("total"))))
    totals = summary.groupBy(*SERIES_KEY, PERIOD).agg(F.sum("actual").alias("total"))
    maps = totals.groupBy(*SERIES_KEY).agg(by_period.alias("values")).withColumn("axis", axis)
    dense = maps.select(
        F.upper(F.concat_ws("::", *SERIES_KEY)).alias("series"),
        F.size("axis").alias("weeks"),
        F.transform("axis", lambda p: F.coalesce(F.element_at("values", p), F.lit(0.0))).alias("v"),
        F.explode(F.array(*[F.lit(lag) for lag in params.indicator_lags])).alias("lag_weeks"),
    )
    pairs_left = F.col("weeks") - F.col("lag_weeks")
    dense = dense.where(
        (F.col("weeks") >= params.min_indicator_weeks) & (pairs_left >= params.min_indicator_pairs)
    ).withColumn("n", pairs_left)
    is_money = F.col("series").contains(MONEY_METRIC)

    names = maps.groupBy().agg(
        F.count_if(F.upper("metric").contains(MONEY_METRIC) | F.upper("source_table").contains(MONEY_METRIC)).alias("money"), F.count("*").alias("all")
    ).first()
    wide, high = (max(1, -(-(n or 0) // BLOCK_SERIES)) for n in (names["money"], names["all"]))

    def centred(rows: DataFrame, name: str, first: Column, dealt: int, others: int) -> DataFrame:
        """The part of each series that pairs under a lag, less its mean, and the length of that vector."""
        zero = F.lit(0.0)
        rows = rows.select("series", "lag_weeks", "n", F.slice("v", first, F.col("n")).alias("part"))
        mean = F.aggregate("part", zero, lambda total, x: total + x) / F.col("n")
        rows = rows.withColumn("mean", mean).withColumn("c", F.transform("part", lambda x: x - F.col("mean")))
        length = F.sqrt(F.aggregate("c", zero, lambda total, x: total + x * x))
        rows = rows.withColumn("length", length).withColumn("own", F.pmod(F.xxhash64("series"), F.lit(dealt)).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        unit = ("own", "other") if name == "target_metric" else ("other", "own")
        return rows.select(
            F.col("series").alias(name), "lag_weeks", "n", F.col(unit[0]).alias("across"), F.col(unit[1]).alias("down"),
            F.col("c").alias(f"c_{name}"), F.col("length").alias(f"l_{name}"),
        )

    targets = centred(dense.where(is_money), "target_metric", F.col("lag_weeks") + 1, wide, high)
    predictors = centred(dense.where(~is_money), "predictor_metric", F.lit(1), high, wide)
    dot = F.aggregate(
        F.zip_with("c_predictor_metric", "c_target_metric", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )
    # corr() itself divides by zero on constant input
    r = F.coalesce(F.try_divide(dot, F.col("l_predictor_metric") * F.col("l_target_metric")), F.lit(0.0))
    return targets.drop("n").join(predictors, ["lag_weeks", "across", "down"]).select(
        "predictor_metric",
        "target_metric",
        "lag_weeks",
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("correlation"),
        F.col("n").cast("bigint").alias("n_observations"),
    )


def lead_significance(correlations: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Student's t of each correlation, its two-sided p value and the verdict."""
    r, free = F.col("correlation"), F.col("n_observations") - 2
    t = F.when(F.abs(r) < 1, r * F.sqrt(free / (1 - r * r))).otherwise(0.0)
    tested = correlations.withColumn("_t", t).withColumn("p_value", student_two_sided_p(F.col("_t"), free))
    return tested.select(
        *correlations.columns,
        "p_value",
        (F.col("p_value") < params.significance).alias("significant"),
        F.when(r > 0, "leading").otherwise("inverse_leading").alias("direction"),
    )


def early_warnings(summary: DataFrame, indicators: DataFrame) -> DataFrame:
    """Significant leading pairs whose predictor is abnormal in the latest period."""
    lead = indicators.where(F.col("significant") & (F.col("direction") == "leading"))
    now = summary.where(
        (F.col(PERIOD) == latest_period(summary)) & F.col("direction").isin("DROP", "SPIKE")
    ).select(
        F.upper(F.concat_ws("::", *SERIES_KEY)).alias("predictor_metric"),
        F.col("pct_diff").alias("predictor_pct_diff"),
        F.col("direction").alias("predictor_direction"),
        "baseline_avg",
    )
    joined = lead.drop("direction").join(now, "predictor_metric")
    projected = F.col("predictor_pct_diff") * F.abs("correlation") * 0.5
    joined = joined.withColumn("projected_impact_pct", projected).withColumn(
        "projected_impact_value",
        F.when(F.col("baseline_avg") != 0, F.col("baseline_avg") * F.col("projected_impact_pct") / 100).otherwise(0.0),
    )

    def dotted(key: str) -> Column:
        parts = F.split(key, "::", 2)
        return F.concat_ws(".", parts[0], parts[1])

    predictor, target = dotted("predictor_metric"), dotted("target_metric")
    narrative = F.format_string(
        "⚠ EARLY WARNING: %s (%s: %s%%) is a leading indicator for %s (lag=%dwk, r=%s). "
        "If pattern holds, expect %s%% impact (≈$%s) in ~%d week(s).",
        predictor,
        "predictor_direction",
        fixed(F.col("predictor_pct_diff"), 1),
        target,
        "lag_weeks",
        fixed(F.col("correlation"), 2),
        fixed(F.col("projected_impact_pct"), 1),
        thousands(F.abs("projected_impact_value")),
        "lag_weeks",
    )
    action = F.format_string(
        "Investigate %s root cause now to mitigate potential downstream impact on %s.", predictor, target
    )
    return joined.select(
        F.lit("LEADING_INDICATOR").alias("warning_type"),
        "predictor_metric",
        "target_metric",
        "lag_weeks",
        "correlation",
        "predictor_pct_diff",
        "predictor_direction",
        "projected_impact_pct",
        "projected_impact_value",
        narrative.alias("narrative"),
        action.alias("recommended_action"),
    )


def warning_lines(warnings: DataFrame) -> DataFrame:
    """The warnings as text lines, largest projected impact first; one line says so if there are none."""
    order = F.struct("predictor_metric", "target_metric", "lag_weeks")
    text = F.concat_ws(" ", "narrative", "recommended_action")
    rows = warnings.select(
        F.lit(0).alias("all"), F.coalesce(-F.round(F.abs("projected_impact_value"), 6), F.lit(0.0)).alias("by"), order.alias("tie"), text.alias("text")
    )
    # numbered in ranges, since warnings grow with the pairs of series
    lines = sequence_numbers(rows, "all", "by", "tie", "line").select(F.col("line").cast("int").alias("line"), "text")
    none = warnings.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("line"), F.lit(NO_WARNING).alias("text"))
    return lines.unionByName(none)


def yoy_comparison(summary: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """The same series exactly 52 weeks earlier; a null or zero prior value is left out."""
    before = summary.select(
        *SERIES_KEY,
        F.date_add(F.col(PERIOD), 7 * params.yoy_weeks).alias(PERIOD),
        F.col("actual").alias("actual_yoy"),
    ).where(F.col("actual_yoy") != 0)
    change = (F.col("actual") - F.col("actual_yoy")) / F.col("actual_yoy") * 100
    return (
        summary.join(before, [*SERIES_KEY, PERIOD])
        .select(*SERIES_KEY, PERIOD, "actual", "actual_yoy", change.alias("yoy_pct_diff"))
        .where(F.col("yoy_pct_diff").isNotNull())
    )
