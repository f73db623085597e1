from __future__ import annotations

import random
import re

import numpy as np
import pytest
from edges import SCHEMA, edge_docs, edge_rows, empty_docs, multiset, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare, connect
from weftmark.llm import minhash
from weftmark.llm.queries import ORACLES, QUERIES

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = SPACE.findall((text or "").encode().lower())
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(docs):
    """doc_id, set size, component and verdict of every row; all pairs are compared."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    ids: dict[int, list] = {}
    for i, (doc, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(doc)
    name = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    found = [(d, len(s), name[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))]
    return multiset((d, n, c, True if c is None else None if d is None else d == c) for d, n, c in found)


def near_copies(seed, rng_words=90, copies=40, changes=2):
    """Copies with some words changed: some pairs above the least similarity, some below."""
    rng = random.Random(seed)
    base = prose(seed, rng_words).split()
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = prose(rng.random(), 1)
        out.append(" ".join(words))
    return out


def got(df):
    return multiset(tuple(r) for r in minhash.keep_first(df).collect())


def test_edge_documents(spark):
    docs = [r[:2] for r in edge_rows()]
    want = multiset((d, n, c, c is None or d == c) if d is not None or c is None else (d, n, c, None) for d, n, c, _ in plain(docs))
    assert got(edge_docs(spark)) == want
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize(("bucket", "block"), [(4096, 1 << 20), (3, 400)])
def test_groups_of_near_copies(spark, monkeypatch, bucket, block):
    # a group in one task, and one cut into pairs of blocks
    monkeypatch.setattr(minhash, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    texts = [t for seed in range(4) for t in near_copies(seed, changes=2 + seed)]
    # a passage that all of these share, in texts that are otherwise their own
    texts += [prose(100 + i, 60) + " " + prose(1, 40) for i in range(30)]
    texts += ["one two", "One TWO", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i j", "b c d e f g h i j k"]
    random.Random(1).shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * 10) for i, t in docs], SCHEMA).repartition(4)
    assert got(df) == plain(docs)


def test_sets_at_the_least_similarity(spark):
    # 20 shingles: 17 of 20 are 85 per cent, 16 of 19 are less
    words = [f"w{i}" for i in range(24)]
    texts = [" ".join(words), " ".join(words[:21]), " ".join(words[:20]), " ".join(["x", "y", *words[2:]])]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * 10) for i, t in docs], SCHEMA)
    assert got(df) == plain(docs)


@given(st.lists(st.integers(6, 400), min_size=1, max_size=6), st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_every_bin_fills_with_the_rounds_of_the_method(sizes, seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in sizes]
    out = minhash.sketches(np.concatenate(sets), np.array([len(s) for s in sets]))
    for own, row in zip(sets, out):
        want = [None] * minhash.BINS
        for turn in range(2 * minhash.BINS):
            before = list(want)
            for value in minhash.mixed(own, turn).tolist():
                place = value % minhash.BINS if turn < minhash.BINS else turn - minhash.BINS
                if before[place] is None and (want[place] is None or value < want[place]):
                    want[place] = value
            if None not in want:
                break
        assert want == row.tolist()


def test_bins_agree_as_sets_are_similar():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.85):
        agreed, apart = [], []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
            both = int(300 * share)
            side = (300 - both) // 2
            a, b = np.unique(pool[: both + side]), np.unique(np.concatenate([pool[:both], pool[both + side :]]))
            sketch = minhash.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
            agreed.append((sketch[0] == sketch[1]).mean())
            two = minhash.two_bits(sketch)
            apart.append(minhash.mismatches(two[0], two[1]))
        assert abs(np.mean(agreed) - share) < 0.02
        assert np.std(agreed) < 0.05
        assert abs(np.mean(apart) - 0.75 * (1 - share) * minhash.BINS) < 5


def test_op12_equals_sql_and_all_pairs(spark, sf_dir):
    found = QUERIES["op12_minhash"](spark, sf_dir)
    assert compare(found, connect(sf_dir), ORACLES["op12_minhash"]) is None
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert multiset(tuple(r) for r in found.collect()) == plain(docs)
