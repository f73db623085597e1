"""Arrow batches inside tasks: slices of bounded size, row keys, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftmark.session import ship_package

# bytes of an Arrow batch between Spark and a worker, about; one row at least
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
# bytes of text that a task holds as words or numbers at a time; a longer text is a slice of its own
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` takes at most ``limit`` bytes in each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes, a null text as an empty one."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start .. start + length - 1 of every entry, joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def set_aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with columns other than ``own`` under names that clash with none, and a function that undoes it.

    Names are taken as they are written, so a column that differs from one of ``own`` by case is another column.
    """
    safe = [n if n in own else f"extra_{i}" for i, n in enumerate(docs.columns)]

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(s).alias(n) for s, n in zip(safe, docs.columns)))

    return docs.toDF(*safe), restore


def own_columns(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns alone."""
    return set_aside(docs, *own)[0].select(*own)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone."""
    return own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def text_key() -> Column:
    """Tells rows with one doc_id and different texts apart; rows equal in both are interchangeable."""
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("bigint"))


def slots(df: DataFrame, rows_each: int) -> int:
    """How many groups of about ``rows_each`` rows the table makes."""
    return df.count() // rows_each + 1


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function that may import this package, in batches of bounded size.

    The bound is a setting of the session, made here unless the session has one.
    """
    spark = df.sparkSession
    ship_package(spark)
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)
