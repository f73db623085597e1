"""Run-event log whose sequence numbers are given when events are written.

An event gets the next number of its run when its batch is appended; inside a batch the order is time, then event id. Files
are laid out by a hash of the run and by ranges of the sequence, so a reader that holds a cursor opens only the files of its run's
bucket at and beyond the cursor, and there only the row groups of the run.

    <path>/layout            buckets, length of a range and schema, fixed when the log begins
    <path>/events/batch=N/run_bucket=B/seq_range=R
    <path>/heads/batch=N     last number of every run after batch N

A batch counts once its heads are written. A batch that failed halfway is overwritten by the next attempt, and readers do
not see it. There is one writer at a time. Events without run or time have no number; they are stored, and no cursor returns them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weftmark.functions.ordering import sequence_numbers

SEQ_RANGE = 1000
# events of a bucket in the first batch, about
BUCKET_EVENTS = 250_000
RUN_BUCKETS_MOST = 4096
_PLACE = StructType([StructField("seq", LongType()), StructField("run_bucket", IntegerType()), StructField("seq_range", LongType())])


def _bucket(run: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run.cast("string")), F.lit(buckets).cast("bigint")).cast("int")


def _layout(spark: SparkSession, path: str) -> tuple[int, int, StructType] | None:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.parquet(f"{path}/layout").first()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return row["run_buckets"], row["seq_range"], StructType.fromJson(json.loads(row["schema"]))


def _committed(spark: SparkSession, path: str) -> int:
    """The last batch that counts, -1 before the first."""
    from pyspark.errors import AnalysisException

    try:
        # names of folders only
        last = spark.read.option("basePath", f"{path}/heads").parquet(f"{path}/heads").agg(F.max("batch")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return -1
    return -1 if last is None else last


def heads(spark: SparkSession, path: str) -> DataFrame:
    """run_id and last_seq of every run."""
    last = _committed(spark, path)
    rows = spark.read.option("basePath", f"{path}/heads").parquet(f"{path}/heads")
    return rows.where((F.col("batch") == last) & F.col("run_id").isNotNull()).drop("batch")


def append_events(events: DataFrame, path: str, seq_range: int = SEQ_RANGE) -> int:
    """Append a batch (run_id, ts, event_id and any other columns); gives the number of the batch."""
    spark = events.sparkSession
    layout = _layout(spark, path)
    if layout is None:
        buckets = min(RUN_BUCKETS_MOST, events.count() // BUCKET_EVENTS + 1)
        stored = StructType([*events.schema.fields, *_PLACE.fields])
        row = [(buckets, seq_range, stored.json())]
        kept = spark.createDataFrame(row, "run_buckets int, seq_range int, schema string").coalesce(1)
        kept.write.mode("overwrite").parquet(f"{path}/layout")
        layout = (buckets, seq_range, stored)
    buckets, each, schema = layout
    batch = _committed(spark, path) + 1
    numbered = sequence_numbers(events, "run_id", "ts", "event_id")
    if batch:
        before = heads(spark, path).withColumnRenamed("last_seq", "_before")
        numbered = numbered.join(before, "run_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_before", F.lit(0)))
        numbered = numbered.drop("_before")
    placed = numbered.select(
        *events.columns, "seq", _bucket(F.col("run_id"), buckets).alias("run_bucket"), F.floor((F.col("seq") - 1) / each).alias("seq_range")
    )
    # a long run is spread over its ranges, so no task writes a whole run
    placed = placed.repartition("run_bucket", "seq_range").sortWithinPartitions("run_bucket", "seq_range", "run_id", "seq")
    target = f"{path}/events/batch={batch}"
    placed.write.mode("overwrite").partitionBy("run_bucket", "seq_range").parquet(target)
    stored = spark.read.schema(schema).parquet(target)
    lasts = stored.where("seq IS NOT NULL").groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    if batch:
        lasts = heads(spark, path).unionByName(lasts).groupBy("run_id").agg(F.max("last_seq").alias("last_seq"))
    # a row without a run stands for a batch without numbers
    mark = spark.createDataFrame([(batch,)], "last_seq bigint").select(F.lit(None).cast(lasts.schema["run_id"].dataType).alias("run_id"), "last_seq")
    lasts.unionByName(mark).write.mode("overwrite").parquet(f"{path}/heads/batch={batch}")
    return batch


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of the batches that count, with ``seq``."""
    schema = StructType([*_layout(spark, path)[2].fields, StructField("batch", IntegerType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/events").parquet(f"{path}/events")
    return rows.where(F.col("batch") <= _committed(spark, path))


def events_after(spark: SparkSession, path: str, run_id, cursor: int) -> DataFrame:
    """Events of a run beyond a cursor, from the files that can hold them."""
    buckets, each, _ = _layout(spark, path)
    mine = (F.col("run_bucket") == _bucket(F.lit(run_id), buckets)) & (F.col("seq_range") >= cursor // each)
    wanted = (F.col("run_id") == run_id) & (F.col("seq") > cursor)
    return read_events(spark, path).where(mine & wanted).drop("batch", "run_bucket", "seq_range")
