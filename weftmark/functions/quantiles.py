"""Exact quantiles without bringing a column to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.session import materialize

# distinct values that one task puts in order, about
VALUES_EACH = 100_000


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(v, c): the distinct values of a column as double and how often each occurs.

    Written once to the shared folder: the steps below read this one narrow table instead of running
    whatever is behind ``df`` again. Equal values are merged before the shuffle.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    return materialize(values.groupBy("v").agg(F.count("*").alias("c")), "value-counts")


def exact_quantiles(counts: DataFrame, probs: list[float]) -> DataFrame:
    """One row (total, q0, q1, ...) of linearly interpolated quantiles of a table of values and counts.

    The distinct values are dealt to slices by ranges of ``v`` that Spark samples, so a slice holds about as many values as
    any other, however they are spread. Counts of the slices say in which ones the wanted ranks lie, and only these are
    put in order.
    """
    slices = counts.count() // VALUES_EACH + 1
    dealt = counts.repartitionByRange(slices, "v").select("v", "c", F.spark_partition_id().alias("s"))
    dealt = materialize(dealt, "value-slices")
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    sums = dealt.groupBy("s").agg(F.sum("c").alias("n"))
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    wanted = F.array(
        *[
            F.struct(
                F.lit(2 * i + up).alias("slot"),
                F.least(F.floor((F.col("total") - 1) * F.lit(float(p))) + up, F.col("total") - 1).alias("rank"),
            )
            for i, p in enumerate(probs)
            for up in (0, 1)
        ]
    )
    here = F.filter("all", lambda w: (F.col("start") <= w["rank"]) & (w["rank"] < F.col("start") + F.col("n")))
    asked = starts.withColumn("all", total.select(wanted).scalar())
    asked = asked.select("s", "start", here.alias("ranks")).where(F.size("ranks") > 0)

    running = F.sum("c").over(Window.partitionBy("s").orderBy("v"))
    placed = dealt.join(asked, "s").withColumn("at", F.col("start") + running - F.col("c"))
    hits = placed.select(
        "v", F.inline(F.filter("ranks", lambda w: (F.col("at") <= w["rank"]) & (w["rank"] < F.col("at") + F.col("c"))))
    )
    out = hits.agg(
        *[F.max(F.when(F.col("slot") == s, F.col("v"))).alias(f"v{s}") for s in range(2 * len(probs))]
    ).withColumn("total", total.scalar())

    def interpolated(i: int, p: float) -> Column:
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        return (low + (high - low) * (at - F.floor(at))).alias(f"q{i}")

    return out.select("total", *[interpolated(i, p) for i, p in enumerate(probs)])
