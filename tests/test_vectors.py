from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weftmark.operators import vectors

SCHEMA = "id bigint, vector array<float>, category string"


def corpus(spark, n=400, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dims)).astype(np.float32)
    rows = [(i, [float(x) for x in p], str(i % 4)) for i, p in enumerate(points)]
    return points, spark.createDataFrame([*rows, (n, None, "0")], SCHEMA).repartition(7)


def brute(points, query, k, skip=None, keep=None):
    distance = np.sqrt(((points.astype(float) - query.astype(float)) ** 2).sum(1))
    order = sorted((d, i) for i, d in enumerate(distance) if i != skip and (keep is None or keep(i)))
    return [i for _, i in order[:k]]


@pytest.mark.parametrize("unit", [8192, 60])
def test_equals_brute_force(spark, monkeypatch, unit):
    """Also in many parts."""
    monkeypatch.setattr(vectors, "UNIT_DOCUMENTS", unit)
    monkeypatch.setattr(vectors, "SMALL_UNIT", unit)
    points, docs = corpus(spark)
    got = vectors.vector_top_k(docs, docs.where("id < 20"), 7, skip_self=True).collect()
    assert len(got) == 140
    for q in range(20):
        ranked = [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert ranked == brute(points, points[q], 7, skip=q)


@pytest.mark.parametrize("unit", [8192, 60])
def test_registered_search_asks_from_every_fiftieth_id(spark, monkeypatch, tmp_path, unit):
    """Also where ids start higher, and with documents in many parts."""
    from weftmark.plans.text_queries import vector_top_k

    monkeypatch.setattr(vectors, "UNIT_DOCUMENTS", unit)
    monkeypatch.setattr(vectors, "SMALL_UNIT", unit)
    points, docs = corpus(spark)
    rows = docs.where("vector IS NOT NULL").selectExpr("id + 1000 AS vec_id", "vector AS embedding", "int(category) AS label")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_top_k(spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == set(range(1000, 1400, 50))
    for q in range(0, 400, 50):
        ranked = [r.id - 1000 for r in sorted((r for r in got if r.query_id == q + 1000), key=lambda r: r["rank"])]
        assert ranked == brute(points, points[q], 5, skip=q)


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, [1.0, 1.0], "a") for i in range(50)], SCHEMA).repartition(9)
    query = spark.createDataFrame([(0, [0.0, 0.0])], "id bigint, vector array<float>")
    got = vectors.vector_top_k(docs, query, 5).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4] and got[0].distance == pytest.approx(2**0.5)


def test_fewer_documents_than_k_and_no_queries(spark):
    _, docs = corpus(spark, n=3)
    assert vectors.vector_top_k(docs, docs.where("id = 0"), 9).count() == 3
    assert vectors.vector_top_k(docs, docs.where("false"), 9).count() == 0


def test_category_filter_after_and_before_the_cut(spark):
    points, docs = corpus(spark)
    query = docs.where("id = 1")
    after = vectors.vector_top_k_category(docs, query, "2", 8).collect()
    assert [r.id for r in sorted(after, key=lambda r: r["rank"])] == [i for i in brute(points, points[1], 8) if i % 4 == 2]
    before = vectors.vector_top_k_category(docs, query, "2", 8, prefilter=True).collect()
    assert [r.id for r in sorted(before, key=lambda r: r["rank"])] == brute(points, points[1], 8, keep=lambda i: i % 4 == 2)


def test_store_does_not_repeat_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, f"t{i}", [0.5], {"k": str(i)}, "c") for i in range(6)]
    schema = "id bigint, text string, vector array<float>, metadata map<string,string>, category string"
    docs = spark.createDataFrame(rows, schema)
    vectors.append_documents(docs.where("id < 4"), path)
    vectors.append_documents(docs, path)
    vectors.seed_documents(docs.withColumn("id", docs.id + 100), path)
    assert vectors.count_documents(spark, path).first().documents == 6
    assert spark.read.parquet(path).where("id = 5").first().metadata == '{"k":"5"}'


def test_vectors_of_other_lengths_are_no_neighbours(spark):
    rows = [(1, [9.0], "a"), (2, [9.0, 9.0], "a"), (3, [1.0, None], "a"), (4, [], "a"), (None, [8.0, 8.0], "a"), (5, [1.0, 2.0, 3.0], "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    query = spark.createDataFrame([(0, [8.0, 9.0])], "id bigint, vector array<float>")
    assert [(r.id, r.distance) for r in vectors.vector_top_k(docs, query, 5).collect()] == [(2, 1.0)]


def test_store_of_repeats_and_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "id bigint, text string, vector array<float>, metadata map<string,string>, category string"
    docs = spark.createDataFrame([(i % 3, f"t{i}", [0.5], {"k": "v"}, "c") for i in range(9)], schema)
    vectors.append_documents(docs.where("false"), path)
    vectors.seed_documents(docs, path)
    assert vectors.count_documents(spark, path).first().documents == 3
    vectors.add_documents(docs, path)
    assert vectors.count_documents(spark, path).first().documents == 12


def test_a_task_holds_few_distances(spark):
    """A unit of many documents and many queries: what a worker holds besides the vectors stays below 40 MB."""
    n, asked = 40_000, 400
    points = np.random.default_rng(3).normal(size=(n, 8))

    def batch(asks, ids):
        flat = pa.array(points[ids].ravel())
        vectors_of = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * 8), flat)
        fixed = [pa.array([8] * len(ids), pa.int32()), pa.array([0] * len(ids), pa.int64()), pa.array([asks] * len(ids))]
        none = pa.array([None] * len(ids), pa.string())
        names = ["length", "unit", "asks", "id", "vector", "category"]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(ids), vectors_of, none], names=names)

    ids = np.arange(n)
    batches = [batch(False, ids[:25_000]), batch(False, ids[25_000:]), batch(True, ids[:150]), batch(True, ids[150:asked])]
    tracemalloc.start()
    found = pa.Table.from_batches(list(vectors._nearest(3, True)(iter(batches)))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert len(found) == 3 * asked
    for q in (0, 149, 150, asked - 1):
        distance = np.linalg.norm(points - points[q], axis=1)
        distance[q] = np.inf
        assert found[found.query_id == q].id.tolist() == np.argsort(distance)[:3].tolist()
