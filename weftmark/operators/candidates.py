"""Approximate vector search by random projections, for corpora that are too large to hold against every query.

A table of the index gives each document a bucket: the signs of its projections on random directions, counted from the
median that a sample of the corpus has there. The number of directions follows the number of documents, so that a bucket
holds about ``BUCKET_DOCUMENTS``. A query asks in its own bucket and in those that differ in the directions where it lies nearest to the
median, in order of the squared distance it would have to move. Queries and documents meet by a join on bucket keys, and every
document that they meet is compared by its exact distance.

How many tables and probes are used is found by calibration: for a bounded sample of the queries the exact neighbours are searched
in the whole corpus, and the cheapest choice that would have met enough of them is taken. In the end a query asks in all
buckets of one table, which is the exact search; uniformly spread vectors come close to that.

A bucket with more than ``UNIT_DOCUMENTS`` documents, as of equal vectors, is cut into parts and its queries ask in all of them; no
document is left out. Vectors that are null, empty or hold a null or non-finite number take no part. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.operators.vectors import _matrix, nearest_in_units, ranked, usable, vector_top_k, with_category
from weftmark.session import materialize, ship_package

BUCKET_DOCUMENTS = 64
MAX_BITS = 24
MAX_TABLES = 4
# documents of the sample that medians come from, and queries that calibrate
SAMPLE_DOCUMENTS = 4096
SAMPLE_QUERIES = 256
RECALL = 0.95
# documents of a bucket's part
UNIT_DOCUMENTS = 8192
# bucket keys that a task makes at a time
BLOCK_KEYS = 1 << 18
SEED = 11


def probe_order(margins: np.ndarray) -> Iterator[int]:
    """Sets of directions to cross, as bits, in order of the sum of their squared margins; none comes first, each once."""
    order = np.argsort(margins, kind="stable")
    cost = margins[order] ** 2
    bits = [1 << int(j) for j in order]
    yield 0
    heap = [(float(cost[0]), 0, bits[0])] if len(cost) else []
    while heap:
        total, last, crossed = heapq.heappop(heap)
        yield crossed
        if last + 1 < len(cost):
            # the next direction in addition to the last, or in its place
            after = last + 1
            heapq.heappush(heap, (total + float(cost[after]), after, crossed | bits[after]))
            heapq.heappush(heap, (total + float(cost[after] - cost[last]), after, crossed ^ bits[last] | bits[after]))


class Projections:
    """Random directions of every table, for each length of vectors, and the medians of a sample."""

    def __init__(self, sample: dict[int, np.ndarray], bits: int, tables: int = MAX_TABLES, seed: int = SEED):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.medians = {n: np.median(self._raw(x), axis=0) for n, x in sample.items() if len(x)}

    def _raw(self, x: np.ndarray) -> np.ndarray:
        directions = np.random.default_rng([self.seed, x.shape[1]]).normal(size=(x.shape[1], self.tables * self.bits))
        return x @ directions

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """Vectors times tables times directions: how far from the median."""
        raw = self._raw(x) - self.medians.get(x.shape[1], 0.0)
        return raw.reshape(len(x), self.tables, self.bits)

    def buckets(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets > 0) @ (1 << np.arange(self.bits, dtype=np.int64))

    def probes(self, x: np.ndarray, number: int) -> np.ndarray:
        """Vectors times tables times probes: buckets in the order in which they are asked."""
        offsets = self.offsets(x)
        home = self.buckets(offsets)
        out = np.empty((*home.shape, number), np.int64)
        for i in range(len(x)):
            for t in range(self.tables):
                out[i, t] = home[i, t] ^ np.fromiter(islice(probe_order(np.abs(offsets[i, t])), number), np.int64, number)
        return out


def calibrate(projections: Projections, queries: list[np.ndarray], neighbours: list[np.ndarray], recall: float) -> tuple[int, int]:
    """Tables and probes that meet the share ``recall`` of the neighbours (rows of a matrix for each query) with least work."""
    everything = 1 << projections.bits
    best = (1, everything)
    total = sum(len(n) for n in neighbours)
    if not total:
        return best
    homes = [projections.buckets(projections.offsets(n)) for n in neighbours]
    probes = 1
    while probes < everything:
        met = np.zeros(projections.tables, np.int64)
        for query, home in zip(queries, homes):
            asked = projections.probes(query[None, :], probes)[0]
            hit = np.stack([np.isin(home[:, t], asked[t]) for t in range(projections.tables)], axis=1)
            met += np.logical_or.accumulate(hit, axis=1).sum(axis=0)
        for tables in range(1, projections.tables + 1):
            if met[tables - 1] >= recall * total and tables * probes < best[0] * best[1]:
                best = (tables, probes)
        if best[1] < everything:
            break  # more probes cost more
        probes = probes * 2 if probes < 16 else probes * 5 // 4
    return best


def _hash(projections: Projections, tables: int, probes: int | None):
    """Adds (table, bucket) of each document, or all that a query asks in."""

    step = max(1, min(1024, BLOCK_KEYS // (projections.tables * (probes or 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == length))
                for lo in range(0, rows.num_rows, step):
                    part = rows.slice(lo, step)
                    x = _matrix(part)
                    keys = projections.buckets(projections.offsets(x))[:, :, None] if probes is None else projections.probes(x, probes)
                    keys = keys[:, :tables] + (np.arange(tables, dtype=np.int64) << MAX_BITS)[:, None]
                    keys = keys.reshape(len(x), -1)
                    ends = np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]
                    cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, cells], names=[*part.schema.names, "buckets"])

    return run


def _finite(rows: DataFrame) -> DataFrame:
    return rows.where(~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))


def _sample(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """The vectors with the smallest hashes of their ids, by length."""
    picked: dict[int, list] = {}
    for row in rows.orderBy(F.xxhash64("id"), "id").limit(n).select("vector").collect():
        picked.setdefault(len(row["vector"]), []).append(row["vector"])
    return {n: np.array(v) for n, v in picked.items()}


def _calibrated(projections: Projections, docs: DataFrame, asked: DataFrame, k: int, skip_self: bool, recall: float) -> tuple[int, int]:
    few = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES)
    true = vector_top_k(docs, few, k, skip_self=skip_self).select("query_id", "id")
    # a few neighbours for each query of the sample
    rows = true.join(docs.select("id", "vector", "length"), "id").join(
        few.select(F.col("id").alias("query_id"), F.col("vector").alias("asked"), F.col("length").alias("asked_length")), "query_id"
    )
    grouped: dict[int, tuple[list, list]] = {}
    for row in rows.where("length = asked_length").select("query_id", "asked", "vector").collect():
        grouped.setdefault(row["query_id"], (row["asked"], []))[1].append(row["vector"])
    return calibrate(projections, [np.array(q) for q, _ in grouped.values()], [np.array(n) for _, n in grouped.values()], recall)


def vector_candidates_lsh(
    docs: DataFrame, queries: DataFrame, k: int = 5, *, skip_self: bool = False, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of the candidates that each query meets, by exact Euclidean distance.

    ``docs`` and ``queries`` have ``id`` and ``vector``; a query id stands for one vector. ``recall`` is the share of exact neighbours
    that calibration asks for.
    """
    spark = docs.sparkSession
    ship_package(spark)
    corpus = materialize(_finite(with_category(docs)), "corpus")
    asked = materialize(_finite(usable(queries)).distinct(), "asked")
    size = corpus.count()
    bits = max(1, min(MAX_BITS, int(np.ceil(np.log2(max(1, size / BUCKET_DOCUMENTS))))))
    projections = Projections(_sample(corpus, SAMPLE_DOCUMENTS), bits)
    tables, probes = _calibrated(projections, corpus, asked, k, skip_self, recall)

    schema = "id long, vector array<double>, length int, buckets array<long>"
    columns = ("id", "vector", "length")
    indexed = corpus.select(*columns).mapInArrow(_hash(projections, tables, None), schema)
    indexed = materialize(indexed.select(*columns, F.explode("buckets").alias("bucket")), "index")
    asking = asked.select(*columns).mapInArrow(_hash(projections, tables, probes), schema)
    asking = asking.select(*columns, F.explode("buckets").alias("bucket"))

    # parts of crowded buckets; all others are one
    crowded = indexed.groupBy("length", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > UNIT_DOCUMENTS)
    crowded = crowded.select("length", "bucket", F.ceil(F.col("n") / UNIT_DOCUMENTS).alias("parts"))

    def in_parts(rows: DataFrame) -> DataFrame:
        rows = rows.join(crowded, ["length", "bucket"], "left")
        return rows.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))

    left = in_parts(indexed).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    right = in_parts(asking).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    unit = F.xxhash64("bucket", "part").alias("unit")
    left = left.select(*columns, unit, F.lit(None).cast("string").alias("category"))
    near = nearest_in_units(left, right.select(*columns, unit), k, skip_self)
    # a document that is met in several tables counts once
    once = near.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return ranked(once, k).select("query_id", "rank", "id", "distance")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact neighbours (query_id, id), and how many of them were found."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(
        F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("found")
    )
