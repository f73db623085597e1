from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from edges import edge_docs, edge_rows, empty_docs, multiset, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmark.llm import simhash, substrings
from weftmark.llm.components import components
from weftmark.llm.queries import QUERIES

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text, lower=False):
    data = (text or "").encode()
    return SPACE.findall(data.lower() if lower else data)


def fingerprint(text):
    words = words_of(text, lower=True)
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def plain_components(docs, roots=False):
    """doc_id, fingerprint and component of every row, all pairs compared; or the name of each component."""
    prints = np.array([fingerprint(t) for _, t in docs], np.uint64)
    sets = Sets(len(docs))
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            sets.join(i, int(j))
    ids: dict[int, list] = {}
    for i, (doc, _) in enumerate(docs):
        ids.setdefault(sets.find(i), []).append(doc)
    name = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    if roots:
        return list(name.values())
    return [(d, f"{int(f):016x}", name[sets.find(i)]) for i, ((d, _), f) in enumerate(zip(docs, prints))]


def found(df):
    rows = df.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")
    return multiset(tuple(r) for r in rows.collect())


def test_simhash_of_edge_documents(spark):
    docs = [r[:2] for r in edge_rows()]
    assert found(simhash.near_duplicates(edge_docs(spark))) == multiset(plain_components(docs))
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_op5_equals_all_pairs(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = multiset(tuple(r) for r in QUERIES["op5_simhash"](spark, sf_dir).collect())
    assert got == multiset(plain_components(docs))


def near_prints(seed, groups, each):
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        at = rng.getrandbits(64)
        for _ in range(each):
            out.add(at)
            for k in rng.sample(range(64), rng.randint(0, 5)):
                at ^= 1 << k
    return sorted(out)


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    # blocks of a few rows, so that crowded cells are cut
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    prints = np.array(near_prints(1, 40, 30), np.uint64)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp bigint")
    sets, other = Sets(len(prints)), Sets(len(prints))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            sets.join(i, int(j))
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    links = simhash.fingerprint_links(frame).collect()
    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
        other.join(place[a], place[b])
    assert [sets.find(i) for i in range(len(prints))] == [other.find(i) for i in range(len(prints))]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.integers(0, 12), st.lists(st.integers(0, 63), max_size=8))
@settings(max_examples=100, deadline=None)
def test_forest_connects_as_much(values, cut, flips):
    values = np.array(sorted({*values, *(values[0] ^ (1 << k) for k in flips)}), np.uint64)
    home, rest = values[:cut], values[cut:]
    old = simhash.BLOCK_PAIRS
    roots = []
    for limit in (1 << 18, 0):
        simhash.BLOCK_PAIRS = limit
        sets = Sets(len(values))
        place = {int(v): i for i, v in enumerate(values)}
        if limit or len(home):
            for a, b in zip(*simhash.forest(home, rest)):
                assert (int(a) ^ int(b)).bit_count() <= 4
                sets.join(place[int(a)], place[int(b)])
        roots.append(sets)
    simhash.BLOCK_PAIRS = old
    for h in home:
        for v in values:
            if (int(h) ^ int(v)).bit_count() <= 4:
                for sets in roots:
                    assert sets.find(place[int(h)]) == sets.find(place[int(v)])


def test_one_row_of_each_component_stays(spark):
    docs = [r[:2] for r in edge_rows()]
    kept = simhash.keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert multiset(r[0] for r in kept.collect()) == multiset(plain_components(docs, roots=True))
    assert simhash.keep_one(empty_docs(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    sets = Sets(400)
    for a, b in links:
        sets.join(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: sets.find(n) for n in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_repeats(docs, window):
    lists = [words_of(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (doc, _), words in zip(docs, lists):
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                covered[i : i + window] = [True] * window
        kept = b" ".join(w for w, c in zip(words, covered) if not c)
        out.append((doc, len(words), sum(covered), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_of_edge_documents(spark):
    docs = [r[:2] for r in edge_rows()]
    got = multiset(tuple(r) for r in substrings.repeat_digests(edge_docs(spark)).collect())
    assert got == multiset(plain_repeats(docs, 35))
    assert substrings.repeat_digests(empty_docs(spark)).count() == 0


def test_repeats_across_slices_and_blocks(spark, monkeypatch):
    # passages with random borders over many small slices, windows and blocks
    rng = random.Random(5)
    pool = [prose(i, 60).split() for i in range(20)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, 50)
            words += p[a : a + rng.randint(1, 40)] + prose(rng.randint(0, 10**9), rng.randint(0, 5)).split()
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    got = multiset(tuple(r) for r in substrings.repeat_digests(frame, window=9, gram=4).collect())
    assert got == multiset(plain_repeats(docs, 9))


@pytest.mark.parametrize("kinds", [1, 2, 7])
def test_small_blocks_lose_nothing(monkeypatch, kinds):
    import pyarrow as pa

    docs = [(i, prose(i % kinds, 20 + 9 * (i % 5))) for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "row_key": list(range(30)), "text": [t for _, t in docs]})
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", 4)
    rows = pa.Table.from_batches(b for i in range(30) for b in substrings._own_factors(9, 4)([batch.slice(i, 1)])).sort_by("minimizer")
    covered: dict[int, set] = {}
    for out in substrings._block_factors(9)(rows.to_batches(max_chunksize=5)):
        for r in out.to_pylist():
            covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    want = {d: n for d, _, n, _ in plain_repeats(docs, 9)}
    assert {d: len(covered.get(d, ())) for d in want} == want


def test_a_large_minimizer_is_held_in_part(monkeypatch):
    """Rows of one minimizer with different windows go on before the last of them has come."""
    import pyarrow as pa

    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", 64)
    read, batches = [0], []
    for i in range(100):
        at = np.arange(20 * i + 1, 20 * i + 21, dtype="<u8")
        batches.append(pa.RecordBatch.from_pydict(
            {
                "minimizer": [7] * 2, "doc_id": [2 * i, 2 * i + 1], "row_key": [0, 0], "start": [0, 0], "end": [10, 10],
                "windows": [at[:10].tobytes(), at[10:].tobytes()], "settled": [bytes(10)] * 2,
            },
            schema=substrings._ROWS,
        ))

    def feed():
        for batch in batches:
            read[0] += 20
            yield batch

    done = 0
    seen = set()
    for out in substrings._block_factors(9, pass_on=True)(feed()):
        assert read[0] - done <= 64 + 20
        done += out.num_rows
        seen.update((r["doc_id"], r["start"], r["windows"]) for r in out.to_pylist())
    assert len(seen) == 2000 and all(w is not None for _, _, w in seen)


def test_a_passage_with_many_borders(spark, monkeypatch):
    # nearly all windows share the minimizer of one passage, and some of them repeat
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", 16)
    passage = prose(1, 10)
    docs = [(i, f"{prose(100 + i % 150, 8)} {passage} {prose(900 + i % 70, 8)} {i}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(60)
    passed = []
    written = substrings.materialize
    def noted(df, name):
        kept = written(df, name)
        if name == "spans":
            passed.append(kept)
        return kept

    monkeypatch.setattr(substrings, "materialize", noted)
    rows_each = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows_each)
    spark.conf.set(rows_each, "5")
    try:
        got = multiset(tuple(r) for r in substrings.repeat_digests(frame, window=12, gram=4).collect())
    finally:
        spark.conf.set(rows_each, usual)
    assert got == multiset(plain_repeats(docs, 12))
    assert passed[0].where("windows IS NOT NULL").count() > 100


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=25), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_factors_are_the_longest(segments):
    """Against a parse that tries every place of the reference."""
    flat = np.array([x for s in segments for x in s], np.uint64)
    cuts = np.cumsum([0, *(len(s) for s in segments)])
    breaks = np.zeros(len(flat), bool)
    breaks[cuts[:-1]] = True
    counts = Counter(flat.tolist())
    first, repeated, begins = substrings.factors(flat, breaks)
    assert [flat.tolist().index(x) for x in flat.tolist()] == first.tolist()
    assert repeated.tolist() == [counts[x] > 1 for x in flat.tolist()]

    def end(i):
        return int(cuts[np.searchsorted(cuts, i, side="right")])

    def same(i, j):
        n = 0
        while i + n < end(i) and j + n < end(j) and flat[i + n] == flat[j + n] and repeated[i + n]:
            n += 1
        return n

    want, i = set(cuts[:-1].tolist()), 0
    while i < len(flat):
        want.add(i)
        if repeated[i]:
            i += max(same(i, j) for j in range(len(flat)) if j != i)
        else:
            stop = i
            while stop < end(i) and not repeated[stop]:
                stop += 1
            i = stop
    assert set(np.flatnonzero(begins).tolist()) == want


def test_only_windows_of_shared_minimizers_move(spark):
    docs = [(i, prose(i, 300)) for i in range(40)] + [(100, prose(3, 120)), (101, prose(3, 300))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(9)
    plan = substrings.duplicate_spans(frame)
    assert plan.where("doc_id < 3 OR doc_id BETWEEN 4 AND 40").count() == 0
    minimizers = substrings.map_arrow(frame, substrings._segment_minimizers(35, 12), "minimizer bigint").groupBy("minimizer").count()
    assert 0 < minimizers.where("count > 1").count() < minimizers.count() / 5


def test_op8_equals_counting_windows(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = multiset(tuple(r) for r in QUERIES["op8_substrings"](spark, sf_dir).collect())
    assert got == multiset(plain_repeats(docs, 35))


@given(st.integers(1, 40), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=80))
@settings(deadline=None)
def test_run_minima(length, values):
    x = np.array(values, np.uint64)
    if len(x) >= length:
        assert substrings.run_minima(x, length).tolist() == [min(values[i : i + length]) for i in range(len(x) - length + 1)]


@given(st.integers(1, 12), st.lists(st.integers(0, 2), min_size=12, max_size=60))
@settings(deadline=None)
def test_run_hashes_tell_runs_apart(length, values):
    hashes = substrings.run_hashes(np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15), length)
    runs = [tuple(values[i : i + length]) for i in range(len(values) - length + 1)]
    assert len(hashes) == len(runs)
    assert len(set(zip(runs, hashes.tolist()))) == len(set(runs)) == len(set(hashes.tolist()))
