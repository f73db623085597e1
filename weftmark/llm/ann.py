"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample, ``SAMPLE_ROWS`` rows with the smallest hashes of their ids; every row is then
indexed in the leaf that it falls to. A query walks the tree best bin first: a priority queue of nodes, by the
inner product with the node's centre plus its spread, gives the leaves in the order of promise. How many leaves are
visited is calibrated: for ``CALIBRATION_QUERIES`` rows that are no queries the exact neighbours among all rows are found,
and the visits are widened until the mean share of them in the visited leaves reaches ``RECALL``. A query goes on
until its leaves hold ``k`` candidates, if there are so many.

Nearness is the largest inner product in double precision, summed from the first component on. Vectors that are null,
empty, zero or hold null or non-finite components take no part, nor do rows without id. Vectors of different length never
meet. Rows with one id are one query (the smallest vector) and never candidates of it; as candidates each counts.
An empty input gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.batches import map_arrow
from weftmark.llm.vectors import UNIT_QUERIES, UNIT_ROWS, best_of, local_best, matrix, products, ranked, usable
from weftmark.session import materialize, ship_package

NEIGHBOURS = 20
QUERY_STEP = 20
SAMPLE_ROWS = 8192
BRANCHES = 8
LEAF_SAMPLE = 48
ROUNDS = 8
CALIBRATION_QUERIES = 256
RECALL = 0.95
SEED = 4


class Tree:
    """Nodes by number: centre, spread, children (none for a leaf)."""

    def __init__(self, sample: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = []
        centres, spreads = [], []
        waiting = [(None, sample)]
        while waiting:
            parent, rows = waiting.pop()
            number = len(centres)
            if parent is not None:
                self.children[parent].append(number)
            centre = rows.mean(axis=0)
            centres.append(centre)
            spreads.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).mean())))
            self.children.append([])
            if len(rows) > LEAF_SAMPLE:
                of = self._split(rows, rng)
                parts = [rows[of == b] for b in np.unique(of)]
                if len(parts) > 1:
                    waiting += [(number, p) for p in parts]
        self.centres, self.spreads = np.array(centres), np.array(spreads)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    @staticmethod
    def _split(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        centres = rows[rng.choice(len(rows), BRANCHES, replace=False)]
        for _ in range(ROUNDS):
            of = Tree.nearest(rows, centres)
            centres = np.array([rows[of == b].mean(axis=0) if (of == b).any() else centres[b] for b in range(BRANCHES)])
        return Tree.nearest(rows, centres)

    @staticmethod
    def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmax(rows @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, at = waiting.pop()
            children = self.children[node]
            if not children:
                out[at] = node
                continue
            of = self.nearest(rows[at], self.centres[children])
            waiting += [(c, at[of == i]) for i, c in enumerate(children) if (of == i).any()]
        return out

    def walk(self, promise: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which a query with these node values reaches them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
            for child in self.children[node]:
                heapq.heappush(queue, (-promise[child], child))

    def promises(self, queries: np.ndarray) -> np.ndarray:
        length = np.sqrt((queries**2).sum(axis=1))
        return queries @ self.centres.T + length[:, None] * self.spreads[None, :]


def _calibrate(rows: DataFrame, tree: Tree, k: int) -> int:
    """Leaves to visit, so that the mean recall of rows that are no queries reaches ``RECALL``."""
    sample = rows.where(F.col("id") % QUERY_STEP != 0).orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_QUERIES).collect()
    if not sample:
        return len(tree.leaves)
    ids, q = np.array([r["id"] for r in sample], np.int64), np.array([r["v"] for r in sample])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = matrix(batch.column("v")), batch.column("id").to_numpy()
            # numbered by place, with rows of the query's own id struck out
            scores = np.where(ids[:, None] == own[None, :], -np.inf, q @ x.T)
            picks = [best_of(s, own, k) for s in scores]
            of = np.repeat(np.arange(len(q)), [len(p) for p in picks])
            at = np.concatenate(picks)
            leaf = tree.leaf_of(x[at])
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(own[at]), pa.array(scores[of, at]), pa.array(leaf)], names=["query_id", "vec_id", "score", "leaf"])

    found = map_arrow(rows.select("id", "v"), exact, "query_id bigint, vec_id bigint, score double, leaf bigint")
    best = ranked(found.withColumnRenamed("vec_id", "own").withColumn("vec_id", F.struct("own", "leaf")), k)
    places = [{leaf: i for i, leaf in enumerate(tree.walk(p))} for p in tree.promises(q)]
    at = [places[r["query_id"]][r["vec_id"]["leaf"]] for r in best.collect()]
    if not at:
        return len(tree.leaves)
    at = np.sort(at)
    visits = 1
    while np.searchsorted(at, visits) < RECALL * len(at):
        visits += 1
    return visits


def _search(rows: DataFrame, k: int) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    tree = Tree(np.array([r["v"] for r in sorted(sample, key=lambda r: r["id"])]))
    visits = _calibrate(rows, tree, k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(tree.leaf_of(matrix(batch.column("v"))))
            yield pa.RecordBatch.from_arrays([leaf, batch.column("id"), batch.column("v")], names=["leaf", "id", "v"])

    indexed = materialize(map_arrow(rows.select("id", "v"), index, "leaf bigint, id bigint, v array<double>"), "leaves")
    held = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for promise in tree.promises(matrix(batch.column("v"))):
                leaves, rows_there = [], 0
                for n, leaf in enumerate(tree.walk(promise)):
                    if n >= visits and rows_there > k:
                        break
                    if leaf in held:
                        leaves.append(leaf)
                        rows_there += held[leaf]
                lists.append(leaves)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(lists, pa.list_(pa.int64()))], names=["id", "v", "leaves"])

    queries = rows.where(F.col("id") % QUERY_STEP == 0).groupBy("id").agg(F.min("v").alias("v"))
    routed = map_arrow(queries.select("id", "v"), route, "id bigint, v array<double>, leaves array<bigint>")
    routed = routed.select("id", "v", F.explode("leaves").alias("leaf"))

    # a crowded leaf is cut into parts, and each part meets blocks of queries
    parts = rows.sparkSession.createDataFrame([(leaf, -(-n // UNIT_ROWS)) for leaf, n in sorted(held.items())], "leaf bigint, parts int")
    blocks = routed.groupBy("leaf").agg(F.ceil(F.count("*") / UNIT_QUERIES).cast("int").alias("blocks"))
    sizes = materialize(parts.join(blocks, "leaf"), "units")
    cut = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    dealt = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    left = routed.join(sizes, "leaf").select("leaf", dealt, each_part, "id", "v")
    right = indexed.join(sizes, "leaf").select("leaf", cut, each_block, "id", "v")

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = q.column("id").to_numpy(), x.column("id").to_numpy()
        of, at, score = local_best(ids, own, products(matrix(q.column("v")), matrix(x.column("v"))), k)
        return pa.table({"query_id": of, "vec_id": at, "score": score})

    ship_package(rows.sparkSession)
    key = ("leaf", "part", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    return ranked(found, k)


def nearest_neighbours(embeddings: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every row whose id is divisible by ``QUERY_STEP``."""
    rows = materialize(usable(embeddings), "vectors")
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.union, [_search(rows.where(F.size("v") == n), k) for n in lengths])
