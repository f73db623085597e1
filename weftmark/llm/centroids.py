"""Centroid clustering of integer vectors with scalar lookup tables.

A component x of a vector counts as the integer floor(64 * x). In each round, a task tabulates for every dimension the
squared differences between the integers that occur there and all centroids; the distances of its vectors are then
gathered from these tables and summed over the dimensions. No product of vectors is taken, and all sums are exact.

A task holds one Arrow batch, the tables of one dimension (values that occur in the batch times ``CLUSTERS``) and the sums of
its vectors by cluster. The driver gets ``CLUSTERS`` sums of ``COMPONENTS`` numbers a round, whatever the number of vectors; no
row is shuffled by its cluster, so a cluster may hold any part of them.

The first centroids are the vectors whose ids have the smallest hashes. A vector goes to the nearest centroid, ties to the
smaller number; each round replaces every centroid that has vectors by their floored mean.

Vectors that are null, of another length than ``COMPONENTS``, or with a null, NaN or infinite component take no part; nor do
those with an integer beyond +-2**27, whose squared distances leave 64 bits. A vector whose id is null takes part, and starts
a centroid only if too few have ids. Repeated rows are vectors of their own; of rows with one id and different vectors, the lesser
vector starts first. With fewer vectors than ``CLUSTERS`` there are as many centroids as vectors. Extra columns are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.llm.batches import map_arrow, own_columns
from weftmark.llm.vectors import matrix
from weftmark.session import materialize

CLUSTERS = 16
ROUNDS = 3
COMPONENTS = 64
SCALE = 64
SEED = 1
LARGEST = 1 << 27


def whole_vectors(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and the integers v of the vectors that take part."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * float(SCALE))
    rows = own_columns(embeddings, "vec_id", "embedding").where(F.size("embedding") == components)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("v"))
    # NaN compares as larger than any number
    fits = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float(LARGEST)))
    return rows.where(fits).select("vec_id", F.transform("v", lambda x: F.floor(x)).alias("v"))


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Vectors times centroids, by one table for each dimension."""
    total = np.zeros((len(vectors), len(centroids)), np.int64)
    for k in range(vectors.shape[1]):
        values, place = np.unique(vectors[:, k], return_inverse=True)
        table = (values[:, None] - centroids[None, :, k]) ** 2
        total += table[place]
    return total


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of several, and the squared distance."""
    total = squared_distances(vectors, centroids)
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _sums(centroids: np.ndarray):
    """Count and component sums of each cluster, one row for each cluster of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), "i8")
                cluster, _ = nearest(x, centroids)
                counts += np.bincount(cluster, minlength=len(counts))
                np.add.at(sums, cluster, x)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(matrix(batch.column("v"), "i8"), centroids)
                columns = [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    named = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(named.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floored means, those without vectors as they were."""
    parts = map_arrow(vectors, _sums(centroids), "cluster int, n bigint, sums array<bigint>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[row["cluster"]] = [int(s) // row["n"] for s in row[2:]]
    return out


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids of a table of ``whole_vectors`` after all rounds."""
    centroids = first_centroids(vectors, clusters)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    return map_arrow(vectors, _assign(centroids), "vec_id bigint, cluster int, distance bigint")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _total(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)")).try_cast("bigint")


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    A sum of distances beyond 64 bits is null.
    """
    vectors = materialize(whole_vectors(embeddings, components), "whole-vectors")
    centroids = fit(vectors, clusters, rounds)
    assigned = materialize(assign(vectors, centroids), "assigned")
    spark = embeddings.sparkSession
    digests = spark.createDataFrame(
        [(i, centroid_digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string"
    )
    of_cluster = assigned.groupBy("cluster").agg(_total(F.col("distance")).alias("cluster_inertia"))
    of_cluster = of_cluster.join(digests, "cluster").withColumn("inertia", assigned.agg(_total(F.col("distance"))).scalar())
    # one row for each of ``clusters``
    rows = assigned.join(F.broadcast(of_cluster), "cluster")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
