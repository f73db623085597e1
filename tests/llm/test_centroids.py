from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare, connect
from weftmark.llm import centroids
from weftmark.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, cluster string, VEC_ID string, distance string"


def edge_vectors(size=4):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=size).round(3).tolist()) for i in range(40)]
    rows += [(100 + i, [0.5, -0.25, 1.0, 0.0]) for i in range(30)]  # copies, a third of all
    rows += [
        (200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [math.nan] * size), (204, [math.inf, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]),
        (206, [2.0**21, 0.0, 0.0, 0.0]), (207, [2.0**20, -(2.0**20), 0.0, -0.001]), (208, [0.0] * size), (None, [0.25] * size), (7, [9.0] * size),
        (7, [9.0] * size), (7, [-3.0] * size), (209, [0.015625, -0.015625, 0.0156, -0.0156]),
    ]
    return rows


def plain(rows, clusters, rounds, size):
    """The whole operator, vector by vector and component by component."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(64 * x) < 2**27 for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in named[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    out = []
    for (i, _), (d, c) in zip(kept, found):
        digest = hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
        out.append((i, c, d, sum(x for x, y in found if y == c), sum(x for x, _ in found), digest))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "w") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("clusters", "rounds"), [(1, 1), (5, 0), (5, 3), (200, 2)])
def test_clusters_of_edge_vectors(spark, clusters, rounds):
    rows = edge_vectors()
    got = centroids.cluster(frame(spark, rows), clusters, rounds, 4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, clusters, rounds, 4)


def test_clusters_of_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [1.0])]):
        assert centroids.cluster(frame(spark, rows), 4, 2, 4).count() == 0


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_tables_give_the_distances(data):
    rows, k, size = (data.draw(st.integers(1, n)) for n in (30, 6, 5))
    whole = st.integers(-(2**27), 2**27)
    x = np.array(data.draw(st.lists(st.lists(whole, min_size=size, max_size=size), min_size=rows, max_size=rows)))
    c = np.array(data.draw(st.lists(st.lists(whole, min_size=size, max_size=size), min_size=k, max_size=k)))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)) for m in c] for v in x]
    assert centroids.squared_distances(x, c).tolist() == want
    cluster, distance = centroids.nearest(x, c)
    assert [(d, j) for j, d in zip(cluster.tolist(), distance.tolist())] == [min((d, j) for j, d in enumerate(w)) for w in want]


def test_op13_equals_sql_and_plain_rounds(spark, sf_dir):
    got = QUERIES["op13_centroids"](spark, sf_dir)
    assert compare(got, connect(sf_dir), ORACLES["op13_centroids"]) is None
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, 16, 3, 64)
