from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from edges import SCHEMA, edge_docs, edge_rows, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare, connect
from weftmark.llm import merkle
from weftmark.llm.queries import ORACLES, QUERIES


def digest(text):
    return sha256(text.encode()).hexdigest()


def row_digest(doc, source, lang, n_chars, text):
    fields = (None if v is None else str(v) for v in (doc, source, lang, n_chars, text))
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def grow(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def climb(levels, i, node):
    """What ``node`` in place of leaf ``i`` gives, and the siblings on the way."""
    siblings = []
    for level in levels[:-1]:
        first = i - i % 2
        run = level[first : first + 2]
        siblings += [x for j, x in enumerate(run, first) if j != i]
        run[i - first] = node
        node, i = digest("".join(run)), i // 2
    return node, siblings


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of every row."""
    trees: dict = {}
    for doc, text, lang, source, n_chars, *_ in rows:
        leaf = row_digest(doc, source, lang, n_chars, text)
        altered = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n_chars is not None
        claim = row_digest(doc, source, lang, n_chars + 1, text) if altered else leaf
        trees.setdefault(lang, []).append((doc is not None, doc or 0, leaf, claim, doc))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {lang: grow([leaf for _, _, leaf, _, _ in sorted(trees[lang])]) for lang in order}
    top = grow([grown[lang][-1][0] for lang in order])
    out = []
    for rank, lang in enumerate(order):
        for i, (_, _, leaf, claim, doc) in enumerate(sorted(trees[lang])):
            subroot, inner = climb(grown[lang], i, claim)
            root, outer = climb(top, rank, subroot)
            out.append((doc, leaf, grown[lang][-1][0], top[-1][0], digest("".join(inner + outer)), root, root == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_levels", [1, 2, 10])
def test_proofs_of_edge_documents(spark, block_levels):
    got = merkle.audit_altered(edge_docs(spark), block_levels)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(edge_rows())


def test_proofs_of_many_languages_and_of_none(spark):
    rows = [(i, f"text {i % 5}", f"l{i % 9}" if i % 9 else None, "s", 6, *["x"] * 10) for i in range(150)]
    got = merkle.audit_altered(spark.createDataFrame(rows, SCHEMA).repartition(5), 2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
    assert merkle.audit_altered(empty_docs(spark)).count() == 0
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert sorted(tuple(r) for r in merkle.audit_altered(one).collect()) == plain(rows[:1])


@given(st.integers(1, 700))
@settings(max_examples=80, deadline=None)
def test_positions_are_the_order_of_completion(leaves):
    nodes = [f"{i:064x}".encode() for i in range(leaves)]
    made = list(merkle.completed(nodes, merkle.height(leaves)))
    assert [int(merkle.position(leaves, level, i)) for level, i, _ in made] == list(range(len(made)))
    levels = grow([n.decode() for n in nodes])
    assert all(levels[level][i] == node.decode() for level, i, node in made)
    for level in range(len(levels)):
        others = [int(merkle.sibling(leaves, level, i)) for i in range(len(levels[level]))]
        assert others == [i ^ 1 if i ^ 1 < len(levels[level]) else -1 for i in range(len(levels[level]))]


def test_log_holds_every_position_once(spark, tmp_path):
    rows = [(i, "t", "en" if i % 3 else "fr", "s", 1, *["x"] * 10) for i in range(300)]
    merkle.write_manifest(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), str(tmp_path), 3)
    blocks = spark.read.parquet(f"{tmp_path}/docs/blocks").collect()
    for tree, total in (("=en", 200), ("=fr", 100)):
        at = []
        for row in blocks:
            if row["tree"] == tree:
                first = row["block"] * 8
                begin = 2 * first - first.bit_count()
                at += range(begin, begin + len(row["nodes"]) // 32)
        upper = spark.read.parquet(f"{tmp_path}/docs/upper").where(f"tree = '{tree}'").collect()
        at += [int(merkle.position(total, r["level"], r["index"])) for r in upper]
        size = sum(len(level) for level in grow(["a"] * total))
        assert sorted(at) == list(range(size))


def test_long_text_is_hashed_whole(spark):
    long = "é" * 3_000_000
    rows = [(1, long, "en", "s", 3_000_000, *["x"] * 10), (2, long + "a", "en", "s", None, *["x"] * 10)]
    got = merkle.audit_altered(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_op11_equals_sql_and_plain_trees(spark, sf_dir):
    got = QUERIES["op11_merkle_manifest"](spark, sf_dir)
    assert compare(got, connect(sf_dir), ORACLES["op11_merkle_manifest"]) is None
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*names).collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
