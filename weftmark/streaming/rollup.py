"""Roll-up of the run-event log kept up to date by a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftmark.functions.numbers import money, ratio
from weftmark.sources import folders

# batches after which their folders are merged
COMPACT_EVERY = 20
_KEY = ["day", "agent"]
_ROWS = (
    "day date, agent string, runs bigint, tokens_in bigint, tokens_out bigint, cost decimal(38,6), seconds decimal(38,4), ok bigint, batch bigint"
)


def rollup_by_day(events: DataFrame, late: str | None = None) -> DataFrame:
    """Per day and agent: events, tokens, cost, seconds and ok events. Works on batch and stream input.

    ``late`` bounds how far behind an event of a stream may arrive: a day that ended so long before the newest event of earlier
    batches takes no more events, and its state is dropped.
    """
    if late:
        events = events.withWatermark("ts", late)
    return (
        events.groupBy(F.window("ts", "1 day").alias("w"), "agent")
        .agg(
            F.count("*").alias("runs"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            F.sum("cost_usd").alias("cost"),
            F.sum("duration_s").alias("seconds"),
            F.count_if(F.col("status") == "ok").alias("ok"),
        )
        .select(F.to_date("w.start").alias("day"), "agent", "runs", "tokens_in", "tokens_out", "cost", "seconds", "ok")
    )


def start_rollup(events: DataFrame, out: str, checkpoint: str, late: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Write the changed rows of every micro-batch to ``out/delta/batch=N``.

    A batch that is run again after a failure overwrites its own folder, so the output stays exact. After every
    ``compact_every`` batches the newest rows are merged into ``out/base/batch=N``, and what the merge before that one has replaced is
    deleted; a reader that began earlier still finds its files. So at most two merged tables and the deltas of two rounds are
    stored, whatever the number of batches.
    """
    spark = events.sparkSession

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/delta/batch={batch}")
        if (batch + 1) % compact_every == 0:
            compact(spark, out, batch)

    return (
        rollup_by_day(events.observe("arrived", F.count("ts").alias("events")), late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    """The newest version of every row, and the batch of the last merge (-1 for none)."""
    merged = max(folders.numbered(spark, f"{out}/base", "batch", complete=True), default=-1)
    later = [n for n in folders.numbered(spark, f"{out}/delta", "batch", complete=True) if n > merged]
    paths = [f"{out}/base/batch={merged}"] * (merged >= 0) + [f"{out}/delta/batch={n}" for n in later]
    # the number of the batch is stored in the rows
    parts = [spark.read.parquet(p).select(*[c.split()[0] for c in _ROWS.split(", ")]) for p in paths]
    rows = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], _ROWS))
    last = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.col("batch").desc()))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n"), merged


def compact(spark: SparkSession, out: str, batch: int) -> None:
    """Merge everything up to ``batch``; running it again gives the same folder."""
    folders.drop(spark, f"{out}/base/batch={batch}")
    rows, before = _newest(spark, out)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/base/batch={batch}")
    for n in folders.numbered(spark, f"{out}/base", "batch"):
        if n < before:
            folders.drop(spark, f"{out}/base/batch={n}")
    for n in folders.numbered(spark, f"{out}/delta", "batch"):
        if n <= before:
            folders.drop(spark, f"{out}/delta/batch={n}")


def arrived_events(query: StreamingQuery) -> int:
    """Events with a time that the last runs of a roll-up stream have read, too late ones included."""
    metrics = [p["observedMetrics"].get("arrived") for p in query.recentProgress]
    return sum(m["events"] for m in metrics if m is not None)


def late_events(arrived: int, out: DataFrame) -> DataFrame:
    """One row: events counted in the roll-up ``out`` and those of ``arrived`` that came too late to count."""
    counted = F.coalesce(F.sum("runs"), F.lit(0))
    return out.agg(counted.alias("counted"), (F.lit(arrived).cast("bigint") - counted).alias("late"))


def read_rollup(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every (day, agent) row."""
    return finish(_newest(spark, out)[0])


def finish(rolled: DataFrame) -> DataFrame:
    return rolled.select(
        "day",
        "agent",
        "runs",
        "tokens_in",
        "tokens_out",
        money(F.col("cost"), 6).alias("total_cost"),
        ratio(F.col("seconds"), F.col("runs")).alias("avg_duration_s"),
        "ok",
    )
