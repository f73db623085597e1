from __future__ import annotations

import math

import numpy as np
import pytest

from weftmark.llm import ann, voronoi
from weftmark.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, v string, cell string, VEC_ID string"


def edge_vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(60)]
    same = [0.5, -0.25, 1.0, 0.0, 0.125]
    rows += [(60 + i, same) for i in range(80)]
    rows += [
        (200, None), (220, []), (240, [0.0] * 5), (260, [1.0, None, 0.0, 0.0, 1.0]), (280, [math.nan] * 5), (300, [math.inf, 0.0, 0.0, 0.0, 0.0]),
        (None, [1.0] * 5), (320, [1.0, 2.0]), (321, [0.5, 0.5]), (40, rows[40][1]), (7, [9.0] * 5), (7, [9.0] * 5),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "w") for i, v in rows], SCHEMA).repartition(3)


def usable(rows, zero):
    ok = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            ok.append((i, v))
    return ok


def brute(rows, k, score):
    """The k best of every query: (query_id, rank, vec_id, score)."""
    queries: dict[tuple, list] = {}
    for i, v in rows:
        if i % 20 == 0:
            queries[i, len(v)] = min(queries.get((i, len(v)), v), v)
    out = []
    for (i, n), q in queries.items():
        found = sorted((-score(q, v), j) for j, v in rows if j != i and len(v) == n)[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


def integers(q, v):
    return sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(q, v))


def doubles(q, v):
    total = 0.0
    for a, b in zip(q, v):
        total += a * b
    return total


@pytest.mark.parametrize("pivots", [1, 8])
def test_voronoi_join_of_edge_vectors(spark, monkeypatch, pivots):
    monkeypatch.setattr(voronoi, "PIVOTS", pivots)
    monkeypatch.setattr(voronoi, "UNIT_ROWS", 30)
    monkeypatch.setattr(voronoi, "UNIT_QUERIES", 2)
    rows = edge_vectors()
    got = sorted(tuple(r) for r in voronoi.top_k(frame(spark, rows), 6).collect())
    assert got == brute(usable(rows, True), 6, integers)


def test_voronoi_join_sends_only_what_may_be_near(spark):
    # far clusters: bounds must rule most of them out, and lose nothing
    rng = np.random.default_rng(2)
    centres = 8 * np.eye(6)
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=6)).tolist()) for i in range(600)]
    got = sorted(tuple(r) for r in voronoi.top_k(frame(spark, rows), 5).collect())
    assert got == brute(rows, 5, integers)
    whole = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    pivots = voronoi.Pivots(whole, float((whole**2).sum(axis=1).max()))
    cell, away = pivots.nearest(pivots.lift(whole))
    cells = {j: sorted(away[cell == j])[:6] for j in set(cell.tolist())}
    ranges = voronoi._bounds(pivots, cells, {j: 0.0 for j in cells}, 5)
    kept = sum(((cell == j) & (away >= low) & (away <= high)).sum() for _, j, low, high in ranges)
    assert kept < len(rows) * len(cells)


def test_integer_products_are_exact_beyond_doubles():
    q, x = np.array([[2**31 - 1, 2**31 - 1]]), np.array([[2**31 - 1, 1], [2**31 - 1, 2]])
    assert voronoi.integer_products(q, x).tolist() == [[(2**31 - 1) ** 2 + 2**31 - 1, (2**31 - 1) ** 2 + 2 * (2**31 - 1)]]


def test_searches_of_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0]), (3, [2.0])], [(20, [1.0])]):
        assert voronoi.top_k(frame(spark, rows)).count() == 0
        assert ann.nearest_neighbours(frame(spark, rows)).count() == 0


def test_op6_equals_all_pairs(spark, sf_dir):
    rows = [(r[0], [float(x) for x in r[1]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in QUERIES["op6_voronoi_join"](spark, sf_dir).collect())
    assert got == brute(rows, 20, integers)


def recall(got, want):
    true = {(q, v) for q, _, v, _ in want}
    return len(true & {(q, v) for q, _, v, _ in got}) / len(true)


def test_op4_finds_most_neighbours(spark, sf_dir):
    rows = [(r[0], [float(x) for x in r[1]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = [tuple(r) for r in QUERIES["op4_kmeans_tree"](spark, sf_dir).collect()]
    want = brute(rows, 20, doubles)
    assert len(got) == len(want)
    assert recall(got, want) >= 0.9
    vectors = dict(rows)
    assert all(s == doubles(vectors[q], vectors[v]) for q, _, v, s in got)


def test_tree_search_of_edge_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_SAMPLE", 8)
    monkeypatch.setattr(ann, "UNIT_ROWS", 30)
    monkeypatch.setattr(ann, "UNIT_QUERIES", 2)
    rows = edge_vectors()
    got = sorted(tuple(r) for r in ann.nearest_neighbours(frame(spark, rows), 6).collect())
    want = brute(usable(rows, False), 6, doubles)
    # all candidates if fewer, in order, ties to the smaller id
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _, _ in want]
    assert recall(got, want) >= 0.9
    by_query: dict[int, list] = {}
    for q, r, v, s in got:
        by_query.setdefault(q, []).append((-s, v))
    assert all(x == sorted(x) for x in by_query.values())
    assert by_query[320] == [(-1.5, 321)]


def test_leaves_hold_every_row_once():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(size=(900, 8)), np.ones((300, 8))])
    tree = ann.Tree(rows)
    of = tree.leaf_of(rows)
    assert set(of.tolist()) <= set(tree.leaves)
    walked = list(tree.walk(tree.promises(rows[:1])[0]))
    assert sorted(walked) == sorted(tree.leaves)
