"""Sequence numbers and gaps inside groups of any size, and deterministic top rows.

A key (a run, say) may hold a large part of all rows, and its rows may all have one time, so neither meets in one task. All
rows are dealt to slices by ranges of (key, time, tie) that Spark samples; a slice holds about as many rows as any other.
Windows run inside (key, slice) and over the slices of a key. A row without key or time has no place in the order; it
is set aside before and kept with a null result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.session import materialize

# rows of a slice, about
ROWS_EACH = 200_000

_SLICE = "_slice"


def _sliced(df: DataFrame, key: str, ts: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a place in the order and their slice, and the rest.

    The slices are written, since a range that is sampled anew could cut elsewhere.
    """
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    rows = df.where(placed)
    slices = rows.count() // ROWS_EACH + 1
    dealt = rows.repartitionByRange(slices, key, ts, tie).withColumn(_SLICE, F.spark_partition_id())
    return materialize(dealt, "slices"), df.where(~placed)


def _before(key: str):
    return Window.partitionBy(key).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)


def sequence_numbers(df: DataFrame, key: str, ts: str, tie: str, name: str = "seq") -> DataFrame:
    """Number the rows of each key by (ts, tie), starting at 1."""
    rows, rest = _sliced(df, key, ts, tie)
    counts = rows.groupBy(key, _SLICE).agg(F.count("*").alias("_n"))
    starts = counts.select(key, _SLICE, F.coalesce(F.sum("_n").over(_before(key)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, _SLICE).orderBy(ts, tie))
    numbered = rows.withColumn("_inside", inside).join(starts, [key, _SLICE])
    numbered = numbered.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))
    return numbered.unionByName(rest.withColumn(name, F.lit(None).cast("bigint")))


def previous_value(df: DataFrame, key: str, ts: str, tie: str, name: str = "previous_ts") -> DataFrame:
    """The ``ts`` of the preceding row of the key, null for its first row."""
    rows, rest = _sliced(df, key, ts, tie)
    lasts = rows.groupBy(key, _SLICE).agg(F.max(ts).alias("_last"))
    lasts = lasts.select(key, _SLICE, F.max("_last").over(_before(key)).alias("_earlier"))
    inside = F.lag(ts).over(Window.partitionBy(key, _SLICE).orderBy(ts, tie))
    joined = rows.withColumn("_inside", inside).join(lasts, [key, _SLICE])
    joined = joined.select(*df.columns, F.coalesce("_inside", "_earlier").alias(name))
    return joined.unionByName(rest.withColumn(name, F.lit(None).cast(df.schema[ts].dataType)))


def top_by(df: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the largest ``by``; ties are broken by the named columns."""
    return df.orderBy(by.desc(), *[F.col(c).asc() for c in ties]).limit(n)
