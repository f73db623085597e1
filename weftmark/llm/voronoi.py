"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors get one more component that brings all to one length; then the largest inner product with a query is the smallest
distance to it, and triangle inequalities hold. A few pivots, taken from a bounded sample of rows, part queries and rows
into cells. From summaries of the cells (largest distance to the pivot, and the ``k + 1`` smallest) follows for every
group of queries a distance within which all its neighbours lie. A row goes to a group only if its distance to its pivot
does not rule it out. Groups are solved locally, by blocks of queries against blocks of rows, with exact integer
products, and the local results are merged.

Components are floor(``SCALE`` * x). Vectors that are null, empty or hold null or non-finite components take no part, nor do
rows without id. Vectors of different length never meet. Rows with one id are one query (the smallest vector) and never
candidates of it; as candidates each counts. An empty input gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.batches import map_arrow
from weftmark.llm.vectors import UNIT_QUERIES, UNIT_ROWS, local_best, matrix, ranked, usable
from weftmark.session import materialize, ship_package

NEIGHBOURS = 20
QUERY_STEP = 20
SCALE = 64
PIVOTS = 8
SAMPLE_ROWS = 1024
# share by which bounds are widened against rounding
SLACK = 1e-6


def integer_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer matrices; by doubles where every partial sum is below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ x.astype(float).T)
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    return np.clip(q.astype(object) @ x.astype(object).T, low, high)


class Pivots:
    """Pivots among rows that were brought to one length."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest  # square of the largest length
        full = self.lift(sample)
        chosen = [0]
        while len(chosen) < min(PIVOTS, len(full)):
            away = np.min([((full - full[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
            chosen.append(int(np.argmax(away)))
        self.at = full[chosen]
        self.between = np.sqrt(((self.at[:, None] - self.at[None]) ** 2).sum(axis=2))

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(float)
        more = np.sqrt(np.maximum(self.longest - (rows**2).sum(axis=1), 0))
        return np.column_stack([rows, more])

    def nearest(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = np.sqrt(np.maximum(((lifted[:, None] - self.at[None]) ** 2).sum(axis=2), 0))
        cell = np.argmin(away, axis=1)
        return cell, away[np.arange(len(cell)), cell]


def _assign(pivots: Pivots, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), "i8")
            lifted = np.column_stack([v.astype(float), np.zeros(len(v))]) if query else pivots.lift(v)
            cell, away = pivots.nearest(lifted)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "v", "cell", "away"]
            )

    return run


def _bounds(pivots: Pivots, cells: dict[int, list[float]], groups: dict[int, float], k: int) -> list[tuple[int, int, float, float]]:
    """For each group of queries and cell of rows: the range of distances to the pivot that is not ruled out."""
    out = []
    for i, reach in groups.items():
        upper = sorted(reach + pivots.between[i, j] + r for j, near in cells.items() for r in near)
        # a query's own row may be among them
        limit = upper[k] if len(upper) > k else np.inf
        for j in cells:
            gap = pivots.between[i, j]
            wide = SLACK * (1 + gap + reach + (limit if np.isfinite(limit) else 0))
            out.append((i, j, float(gap - reach - limit - wide), float(gap + reach + limit + wide)))
    return out


def _join(rows: DataFrame, k: int) -> DataFrame:
    spark = rows.sparkSession
    # repeated ids of queries are few; more than k of one id only widen the bound
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = rows.agg(F.max(length)).first()[0]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    pivots = Pivots(np.array([r["v"] for r in sorted(sample, key=lambda r: (r["id"], r["v"]))]), longest)
    schema = "id bigint, v array<bigint>, cell int, away double"
    data = materialize(map_arrow(rows.select("id", "v"), _assign(pivots, False), schema), "cells")
    asked = rows.where(F.col("id") % QUERY_STEP == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = materialize(map_arrow(asked.select("id", "v"), _assign(pivots, True), schema), "queries")
    if queries.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    # summaries: a few numbers for each cell. Rows of one id count once, since a query leaves out all rows of its own
    near = data.groupBy("cell", "id").agg(F.max("away").alias("away"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("away"))).where(F.col("n") <= k + 1)
    cells: dict[int, list[float]] = {}
    for r in near.select("cell", "away").collect():
        cells.setdefault(r["cell"], []).append(r["away"])
    sizes = {r["cell"]: (r["far"], r["n"]) for r in queries.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).collect()}
    ranges = _bounds(pivots, cells, {i: far for i, (far, _) in sizes.items()}, k)
    bounds = spark.createDataFrame(
        [(i, j, low, high, -(-sizes[i][1] // UNIT_QUERIES)) for i, j, low, high in ranges],
        "group int, cell int, low double, high double, blocks int",
    )
    parts = data.count() // UNIT_ROWS + 1
    sent = data.join(bounds, "cell").where((F.col("away") >= F.col("low")) & (F.col("away") <= F.col("high")))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    right = sent.select("group", part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
    blocks = spark.createDataFrame([(i, -(-n // UNIT_QUERIES)) for i, (_, n) in sorted(sizes.items())], "cell int, blocks int")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    left = queries.join(blocks, "cell").select(
        F.col("cell").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block, "id", "v"
    )

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        ids, own = q.column("id").to_numpy(), x.column("id").to_numpy()
        scores = integer_products(matrix(q.column("v"), "i8"), matrix(x.column("v"), "i8"))
        of, at, score = local_best(ids, own, scores, k)
        return pa.table({"query_id": of, "vec_id": at, "score": pa.array(score.astype(np.int64))})

    ship_package(spark)
    key = ("group", "part", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    return ranked(found, k)


def top_k(embeddings: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of every row whose id is divisible by ``QUERY_STEP``."""
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("bigint"))
    rows = materialize(usable(embeddings, zero=True).select("id", whole.alias("v")), "integers")
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return reduce(DataFrame.union, [_join(rows.where(F.size("v") == n), k) for n in lengths])
