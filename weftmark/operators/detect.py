"""Five detection layers and their vote, over weekly series.

Every window shares one partitioning (source, metric) and one order (period), so the whole chain costs a
single shuffle of the aggregated series; a series holds one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.config import PERIOD, SERIES_KEY, DetectorParams
from weftmark.functions.numbers import ratio
from weftmark.functions.ordering import top_by

OUTPUT = (
    "source_table", PERIOD, "metric", "actual", "baseline_avg", "baseline_std", "baseline_count", "pct_diff",
    "z_score", "iqr_outlier", "cusum_high", "cusum_low", "bayes_change_prob", "ensemble_score",
    "consensus_strength", "n_agreeing_layers", "direction", "severity",
)


def _per_series():
    return Window.partitionBy(*SERIES_KEY).orderBy(PERIOD)


def _prior(params: DetectorParams):
    return _per_series().rowsBetween(-params.baseline_weeks, -1)


def rolling_baseline(series: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Count, mean and sample deviation of the prior periods; null below the minimum count."""
    prior = _prior(params)
    seen = F.count("value").over(prior)
    enough = seen >= params.min_baseline_obs
    return series.select(
        "*",
        F.when(enough, seen).alias("baseline_count"),
        F.when(enough, F.avg("value").over(prior)).alias("baseline_avg"),
        F.when(enough, F.stddev_samp("value").over(prior)).alias("baseline_std"),
    )


def pct_diff(df: DataFrame) -> DataFrame:
    return df.withColumn("pct_diff", ratio(F.col("value") - F.col("baseline_avg"), F.col("baseline_avg")) * 100)


def z_score(df: DataFrame) -> DataFrame:
    return df.withColumn("z_score", ratio(F.col("value") - F.col("baseline_avg"), F.col("baseline_std")))


def iqr_outlier(df: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Outside the fences of the prior periods. The minimum count does not apply to this layer."""
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(_prior(params))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    reach = (q3 - q1) * params.iqr_multiplier
    outside = (F.col("value") < q1 - reach) | (F.col("value") > q3 + reach)
    return (
        df.withColumn("_q", quartiles)
        .withColumn("iqr_outlier", F.coalesce(outside, F.lit(False)))
        .drop("_q")
    )


def bayes_change_prob(df: DataFrame) -> DataFrame:
    """1 / (1 + exp(-n z^2 / 4)): the posterior odds with the standard error of the mean put in.

    0.5 where there is no baseline or no deviation.
    """
    factor = F.exp(-F.col("baseline_count") * F.col("z_score") * F.col("z_score") / 4.0)
    return df.withColumn("bayes_change_prob", F.coalesce(1.0 / (1.0 + factor), F.lit(0.5)))


def cusum(
    df: DataFrame,
    params: DetectorParams = DetectorParams(),
    start_high: Column | None = None,
    start_low: Column | None = None,
) -> DataFrame:
    """Cumulative drift sums with slack and floor 0, without a sequential fold.

    A sum that is reset to 0 whenever it would go negative equals the free running sum minus its running
    minimum (capped at 0). Periods without a baseline add nothing. A carried-in state is where the free sum
    starts.
    """
    upto = _per_series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("z_score")
    rise = F.coalesce(step - params.cusum_slack, F.lit(0.0))
    fall = F.coalesce(-step - params.cusum_slack, F.lit(0.0))
    high0 = F.lit(0.0) if start_high is None else start_high
    low0 = F.lit(0.0) if start_low is None else start_low
    free = df.withColumn("_h", high0 + F.sum(rise).over(upto)).withColumn("_l", low0 + F.sum(fall).over(upto))
    return (
        free.withColumn("cusum_high", F.col("_h") - F.least(F.lit(0.0), F.min("_h").over(upto)))
        .withColumn("cusum_low", F.col("_l") - F.least(F.lit(0.0), F.min("_l").over(upto)))
        .drop("_h", "_l")
    )


def ensemble(df: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Weighted vote of the layers, how many of them vote, and their share."""
    side = F.when(F.col("value") < F.col("baseline_avg"), -1).otherwise(1)

    def two_sided(value: Column, low: float, high: float) -> Column:
        return F.when(value <= low, -1).when(value >= high, 1).otherwise(0)

    votes = [
        two_sided(F.col("pct_diff"), params.pct_drop, params.pct_spike),
        two_sided(F.col("z_score"), -params.z_threshold, params.z_threshold),
        F.when(F.col("iqr_outlier"), side).otherwise(0),
        F.when(F.col("cusum_high") > params.cusum_threshold, 1)
        .when(F.col("cusum_low") > params.cusum_threshold, -1)
        .otherwise(0),
        F.when(F.col("bayes_change_prob") > params.bayes_threshold, side).otherwise(0),
    ]
    weighted = sum((v * w for v, w in zip(votes, params.layer_weights)), F.lit(0.0))
    agreeing = sum((F.abs(v) for v in votes), F.lit(0))
    return df.select(
        "*",
        (weighted / sum(params.layer_weights)).alias("ensemble_score"),
        agreeing.cast("int").alias("n_agreeing_layers"),
        (agreeing / float(len(votes))).alias("consensus_strength"),
    )


def direction(df: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    score, limit = F.col("ensemble_score"), params.direction_threshold
    return df.withColumn(
        "direction", F.when(score <= -limit, "DROP").when(score >= limit, "SPIKE").otherwise("NORMAL")
    )


def severity(df: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    large = (F.abs("pct_diff") >= params.pct_critical) | (F.abs("z_score") >= params.z_critical)
    consensus = F.col("consensus_strength")
    return df.withColumn(
        "severity",
        F.when(F.col("direction") == "NORMAL", "LOW")
        .when(large, "CRITICAL")
        .when((consensus >= params.high_consensus) & (F.col("direction") == "DROP"), "HIGH")
        .when(consensus >= params.medium_consensus, "MEDIUM")
        .otherwise("LOW"),
    )


def layers(series: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """All layers up to the vote, with the value still named ``value``."""
    df = z_score(pct_diff(rolling_baseline(series, params)))
    df = cusum(bayes_change_prob(iqr_outlier(df, params)), params)
    return severity(direction(ensemble(df, params), params), params)


def detect_anomalies(series: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Source, metric, period and value in; the 18 detector columns out."""
    return layers(series, params).withColumnRenamed("value", "actual").select(*OUTPUT)


def top_anomalies(summary: DataFrame, n: int = 10) -> DataFrame:
    """The strongest abnormal periods. Scores are multiples of 1/14, so ties are common."""
    odd = summary.where(F.col("direction") != "NORMAL")
    top = top_by(odd, F.round(F.abs("ensemble_score"), 9), n, PERIOD, "source_table", "metric")
    return top.select(
        F.col(PERIOD).alias("week"),
        "source_table",
        "metric",
        "direction",
        "severity",
        F.round("pct_diff", 1).alias("pct_diff"),
        F.round("z_score", 2).alias("z_score"),
        F.round("actual", 2).alias("actual"),
        F.round("baseline_avg", 2).alias("baseline_avg"),
    )
