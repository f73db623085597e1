"""Rows with usable vectors, and blocks of queries against blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.batches import own_columns

# rows and queries that meet in one unit of work
UNIT_ROWS = 8192
UNIT_QUERIES = 1024



def usable(embeddings: DataFrame, zero: bool = False) -> DataFrame:
    """id and v (doubles) of rows with an id and a vector of finite numbers; zero vectors only if asked for."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = own_columns(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~F.coalesce(bad, F.lit(True)))
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array, kind: str = "f8") -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on, so that equal vectors get equal numbers."""
    out = np.zeros((len(q), len(x)))
    columns = np.ascontiguousarray(x.T)
    for k in range(q.shape[1]):
        out += q[:, k, None] * columns[k]
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id; -inf is left out."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def local_best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The ``k`` best rows of each query, its own left out: arrays of query, row and score."""
    if len(query_ids) and len(ids):
        scores = np.where(query_ids[:, None] == ids[None, :], -np.inf, scores)
    picks = [best_of(s, ids, k) for s in scores]
    of = np.repeat(np.arange(len(picks)), [len(p) for p in picks])
    at = np.concatenate([np.zeros(0, np.int64), *picks]).astype(np.int64)
    return query_ids[of], ids[at], scores[of, at]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the local results: query_id, rank, vec_id, score."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
