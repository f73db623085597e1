"""Vector search: exact nearest neighbours of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmark.session import ship_package

# documents that a task holds at a time, on average, and least documents of a unit where there are few
UNIT_DOCUMENTS = 32_768
SMALL_UNIT = 1024
# distances that a task holds at a time
BLOCK_DISTANCES = 1 << 20

UNIT = "length int, unit long, asks boolean, id long, vector array<double>, category string"
RESULT = "query_id long, id long, distance double, category string"


class _Documents:
    """The documents of a unit."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        self.ids, self.category = rows.column("id").to_numpy(), rows.column("category")
        self.points = _matrix(rows)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, place of the document and distance of the k nearest of every query, ties to the smaller id."""
        of, places, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        step = max(1, BLOCK_DISTANCES // len(self.ids))
        for lo in range(0, len(ids), step):
            block = queries[lo : lo + step]
            rough = block @ self.points.T
            rough *= -2
            rough += self.squares
            rough[np.isnan(rough)] = np.inf
            # more than what rounding may change
            slack = 1e-9 * (np.abs(self.squares).max() + np.einsum("ij,ij->i", block, block))
            for i, q in enumerate(ids[lo : lo + step]):
                near = rough[i]
                own = self.ids == q if skip_self else np.zeros(0, bool)
                spare = k + int(own.sum())
                at = np.arange(len(near))
                if len(near) > spare:
                    at = np.flatnonzero(~(near > np.partition(near, spare - 1)[spare - 1] + slack[i]))
                if skip_self:
                    at = at[~own[at]]
                gap = self.points[at] - block[i]
                distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                best = np.lexsort((self.ids[at], distance))[:k]
                of.append(np.full(len(best), lo + i))
                places.append(at[best])
                distances.append(distance[best])
        return np.concatenate(of), np.concatenate(places), np.concatenate(distances)


def _nearest(k: int, skip_self: bool):
    """The k nearest documents of a unit for each of its queries; a unit's documents come before its queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, docs = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "unit", "asks")])
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0).any(axis=0)])).tolist()
            for lo, hi in zip(begins, [*begins[1:], batch.num_rows]):
                rows, unit = batch.slice(lo, hi - lo), (int(key[0, lo]), int(key[1, lo]))
                if unit != now:
                    now, held, docs = unit, [], None
                if not key[2, lo]:
                    held.append(rows)
                elif held or docs:
                    # the batches are let go with the matrix made
                    docs, held = docs or _Documents(held), []
                    ids = rows.column("id").to_numpy()
                    of, at, distance = docs.nearest(ids, _matrix(rows), k, skip_self)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[of]), pa.array(docs.ids[at]), pa.array(distance), docs.category.take(pa.array(at)).combine_chunks()],
                        names=["query_id", "id", "distance", "category"],
                    )

    return search


def _matrix(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = rows.column("vector")
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def usable(rows: DataFrame, *extra: str) -> DataFrame:
    """Rows with an id and a vector without null elements, and the vector's length."""
    vector = F.col("vector").cast("array<double>")
    rows = rows.select(F.col("id").cast("long").alias("id"), vector.alias("vector"), *extra)
    rows = rows.where("id IS NOT NULL AND size(vector) > 0").where(~F.exists("vector", lambda x: x.isNull()))
    return rows.withColumn("length", F.size("vector"))


def with_category(docs: DataFrame) -> DataFrame:
    category = F.col("category").cast("string") if "category" in docs.columns else F.lit(None).cast("string")
    return usable(docs.withColumn("category", category), "category")


def nearest_in_units(docs: DataFrame, queries: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """query_id, id, distance, category: the k nearest documents of each query in each of its units.

    Both sides have ``length``, ``unit``, ``id`` and ``vector``. A task holds the documents of one unit, while any number of
    queries passes by.
    """
    ship_package(docs.sparkSession)
    columns = [f.split()[0] for f in UNIT.split(", ")]
    left = docs.withColumn("asks", F.lit(False)).select(*columns)
    right = queries.withColumn("asks", F.lit(True)).withColumn("category", F.lit(None).cast("string")).select(*columns)
    rows = left.unionByName(right).repartition("length", "unit").sortWithinPartitions("length", "unit", "asks")
    return rows.mapInArrow(_nearest(k, skip_self), RESULT)


def ranked(near: DataFrame, k: int) -> DataFrame:
    """The k nearest over all units, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(docs: DataFrame, queries: DataFrame, k: int, skip_self: bool) -> DataFrame:
    corpus, asked = with_category(docs), usable(queries).distinct()
    size, tasks = corpus.count(), docs.sparkSession.sparkContext.defaultParallelism
    parts = max(size // UNIT_DOCUMENTS + 1, min(tasks, size // SMALL_UNIT + 1))
    # a document lies in one part, a query passes by all
    corpus = corpus.withColumn("unit", F.pmod(F.xxhash64("id"), F.lit(parts).cast("long")))
    asked = asked.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return ranked(nearest_in_units(corpus, asked, k, skip_self), k)


def vector_top_k(docs: DataFrame, queries: DataFrame, k: int = 5, *, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest documents of each query by Euclidean distance.

    ``docs`` and ``queries`` have ``id`` and ``vector``; a query id stands for one vector. Exact: documents are dealt once, to parts
    of about ``UNIT_DOCUMENTS``; all queries pass by every part, which sends on k rows for each, and these are ranked. Ties go
    to the smaller id. Vectors that are null, empty or hold a null take no part; a document whose vector has another length
    than the query's is no neighbour of it.
    """
    return _search(docs, queries, k, skip_self).select("query_id", "rank", "id", "distance")


def vector_top_k_category(
    docs: DataFrame, queries: DataFrame, category: str, k: int = 5, *, prefilter: bool = False, skip_self: bool = False
) -> DataFrame:
    """Search within a category.

    Without ``prefilter`` the cut comes first, so fewer than k rows may remain.
    """
    inside = F.col("category") == category
    found = _search(docs.where(inside) if prefilter else docs, queries, k, skip_self).where(inside)
    return found.select("query_id", "rank", "id", "distance")


def _store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored documents, or nothing where no store is yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select("id", "text", "vector", F.to_json("metadata").alias("metadata"), "category")


def add_documents(docs: DataFrame, path: str) -> None:
    """Add documents (id, text, vector, metadata, category) as they are, stored ids or not."""
    _ready(docs).write.mode("append").parquet(path)


def append_documents(docs: DataFrame, path: str) -> None:
    """Add documents whose id is not stored yet; of several with one id in the batch, one."""
    ready = _ready(docs).dropDuplicates(["id"])
    stored = _store(docs.sparkSession, path)
    if stored is not None:
        ready = ready.join(stored.select("id"), "id", "left_anti")
    ready.write.mode("append").parquet(path)


def seed_documents(docs: DataFrame, path: str) -> None:
    """Write the default documents only into a store without rows."""
    stored = _store(docs.sparkSession, path)
    if stored is None or stored.isEmpty():
        append_documents(docs, path)


def count_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count("*").alias("documents"))
