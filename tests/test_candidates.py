from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmark.operators import candidates, vectors

SCHEMA = "id bigint, vector array<double>, category string"


def frame(spark, points):
    return spark.createDataFrame([(i, list(map(float, p)), "c") for i, p in enumerate(points)], SCHEMA).repartition(6)


def clustered(n=3000, dims=16, groups=60, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 4
    return centres[rng.integers(groups, size=n)] + rng.normal(size=(n, dims))


@given(st.lists(st.floats(0, 100), min_size=1, max_size=7))
@settings(max_examples=100, deadline=None)
def test_probes_come_in_order_of_cost(margins):
    got = list(candidates.probe_order(np.array(margins)))
    assert sorted(got) == list(range(1 << len(margins)))
    cost = [sum(m * m for j, m in enumerate(margins) if crossed >> j & 1) for crossed in got]
    assert all(a <= b + 1e-9 * (1 + b) for a, b in zip(cost, cost[1:]))


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_recall_is_reached_and_distances_are_exact(spark, kind):
    points = clustered() if kind == "clustered" else np.random.default_rng(2).normal(size=(3000, 16))
    docs = frame(spark, points)
    asked = docs.where("id % 50 = 0")
    got = candidates.vector_candidates_lsh(docs, asked, 5, skip_self=True)
    exact = vectors.vector_top_k(docs, asked, 5, skip_self=True)
    row = candidates.recall_of(got, exact).first()
    assert (row.queries, row.neighbours) == (60, 300) and row.found >= 0.9 * row.neighbours
    by_query: dict[int, list] = {}
    for r in got.collect():
        assert r.distance == pytest.approx(float(np.linalg.norm(points[r.query_id] - points[r.id])))
        assert r.query_id != r.id
        by_query.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for rows in by_query.values():
        rows.sort()
        assert [x for x, _, _ in rows] == list(range(1, len(rows) + 1))
        assert [x[1:] for x in rows] == sorted(x[1:] for x in rows)


def test_clustered_vectors_need_a_small_part_of_the_buckets():
    points = clustered(8000)
    projections = candidates.Projections({16: points[:4096]}, 7)
    queries = [points[i] for i in range(0, 400, 4)]
    near = [points[np.argsort(((points - q) ** 2).sum(1))[1:6]] for q in queries]
    tables, probes = candidates.calibrate(projections, queries, near, 0.95)
    assert tables * probes < 0.5 * 2**7


@pytest.mark.parametrize("unit", [8192, 50])
def test_crowded_buckets_lose_nothing(spark, monkeypatch, unit):
    # a third of all vectors are equal, so they share every bucket
    monkeypatch.setattr(candidates, "UNIT_DOCUMENTS", unit)
    points = clustered(600, 8, 10)
    points[:200] = 1.0
    docs = frame(spark, points)
    asked = docs.where("id IN (0, 100, 199, 300)")
    got = candidates.vector_candidates_lsh(docs, asked, 250, skip_self=True, recall=1.0)
    want = vectors.vector_top_k(docs, asked, 250, skip_self=True)
    for q in (0, 100, 199):
        found = [r.id for r in got.where(f"query_id = {q} AND distance = 0").orderBy("rank").collect()]
        assert found == [i for i in range(200) if i != q]
    row = candidates.recall_of(got, want).first()
    assert row.found >= 0.9 * row.neighbours


def test_edge_vectors(spark):
    rows = [
        (0, None, "a"), (1, [], "a"), (2, [1.0, None], "a"), (3, [math.nan, 1.0], "a"), (4, [math.inf, 1.0], "a"), (None, [1.0, 1.0], "a"),
        (5, [1.0, 1.0], "a"), (6, [1.0, 1.0], "a"), (7, [2.0, 1.0], "a"), (8, [1.0, 1.0, 1.0], "a"), (9, [0.0, 0.0], "a"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = candidates.vector_candidates_lsh(docs, docs.where("id = 5"), 9, skip_self=True)
    assert [(r.id, r.distance) for r in got.orderBy("rank").collect()] == [(6, 0.0), (7, 1.0), (9, pytest.approx(2**0.5))]
    assert candidates.vector_candidates_lsh(docs.where("false"), docs).count() == 0
    assert candidates.vector_candidates_lsh(docs, docs.where("false")).count() == 0


def test_bucket_keys_are_made_in_blocks():
    """Many probes come in batches of a bounded number of keys, for every row and as they are asked."""
    x = np.random.default_rng(5).normal(size=(700, 6))
    projections = candidates.Projections({6: x}, 12, 3)
    rows = pa.ListArray.from_arrays(pa.array(np.arange(701, dtype=np.int32) * 6), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), rows, pa.array([6] * 700, pa.int32())], names=["id", "vector", "length"])
    out = list(candidates._hash(projections, 2, 1000)(iter([batch])))
    assert max(sum(len(b) for b in part.column("buckets").to_pylist()) for part in out) <= 1 << 18
    keys = {row["id"]: row["buckets"] for part in out for row in part.to_pylist()}
    want = projections.probes(x, 1000)[:, :2] + (np.arange(2) << candidates.MAX_BITS)[:, None]
    assert keys == {i: want[i].ravel().tolist() for i in range(700)}
