from __future__ import annotations

import json
import random
from fractions import Fraction
from itertools import product

import pytest
from edges import edge_docs, edge_rows, empty_docs, multiset, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmark.llm import mixing
from weftmark.llm.queries import QUERIES


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@given(st.lists(st.integers(0, 50), min_size=1, max_size=7), st.booleans())
@settings(max_examples=200, deadline=None)
def test_targets_share_by_weight_up_to_the_stop(sizes, null):
    sources = {chr(97 + i): n for i, n in enumerate(sizes)}
    if null:
        sources[None] = 5
    targets = mixing.source_targets(sources)
    assert sum(targets.values()) == Fraction(3, 2) * sum(sources.values())
    names = sorted(s for s in sources if s is not None) + [None] * null
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free = {targets[s] / weights[s] for s in names if targets[s] < 2 * sources[s]}
    assert all(targets[s] <= 2 * sources[s] for s in names) and len(free) <= 1
    for level in free:
        assert all(level * weights[s] >= targets[s] for s in names)


def cheapest(patterns, members, quotas, repeats):
    """Smallest cost of the largest flow, all flows tried."""
    edges = [(p, s) for p in sorted(patterns) for s in members[p]]
    best = None
    for flow in product(*(range(min(repeats * patterns[p], quotas[s]) + 1) for p, s in edges)):
        by_p, by_s = {}, {}
        for (p, s), f in zip(edges, flow):
            by_p[p] = by_p.get(p, 0) + f
            by_s[s] = by_s.get(s, 0) + f
        if all(by_p[p] <= repeats * patterns[p] for p in by_p) and all(by_s[s] <= quotas[s] for s in by_s):
            cost = sum(sum(k // patterns[p] for k in range(f)) for p, f in by_p.items() if patterns[p])
            key = (-sum(flow), cost)
            best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest_of_the_largest(seed):
    rng = random.Random(seed)
    sources = ["a", "b"]
    members = {"p": ["a"], "q": ["a", "b"], "r": ["b"]}
    patterns = {p: rng.randint(0, 3) for p in members}
    quotas = {s: rng.randint(0, 6) for s in sources}
    flow = mixing.route_words(patterns, members, quotas, 2)
    by_p = {p: sum(f for (x, _), f in flow.items() if x == p) for p in members}
    cost = sum(sum(k // patterns[p] for k in range(f)) for p, f in by_p.items() if patterns[p])
    assert (-sum(flow.values()), cost) == cheapest(patterns, members, quotas, 2)


def check_mix(rows, docs):
    sizes = {}
    for source, n in docs:
        sizes[source] = sizes.get(source, 0) + n
    targets = mixing.source_targets(sizes)
    assert all(r["taken"] <= 2 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0) for r in rows)
    return sizes, targets


def test_op9_comes_near_its_targets(spark, sf_dir):
    docs = {r[0]: (r[2], words(r[1])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()}
    rows = QUERIES["op9_mixing"](spark, sf_dir).collect()
    assert multiset((r["doc_id"], r["size"]) for r in rows) == multiset((d, n) for d, (_, n) in docs.items())
    sizes, targets = check_mix(rows, docs.values())
    taken: dict = {}
    for r in rows:
        source = docs[r["doc_id"]][0]
        assert r["source_size"] == sizes[source] and abs(r["target"] - float(targets[source])) < 1e-6
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= max(0.03 * sizes[s], 30) for s in sizes)
    again = QUERIES["op9_mixing"](spark, sf_dir).collect()
    assert multiset(map(tuple, again)) == multiset(map(tuple, rows))


def test_mix_of_edge_documents(spark):
    rows = mixing.mix_by_source(edge_docs(spark)).collect()
    docs = [(r[3], words(r[1])) for r in edge_rows()]
    assert multiset((r["doc_id"], r["size"]) for r in rows) == multiset((r[0], words(r[1])) for r in edge_rows())
    check_mix(rows, docs)
    assert mixing.mix_by_source(empty_docs(spark)).count() == 0


def test_copies_of_the_mix(spark):
    docs = edge_docs(spark)
    out = mixing.take(docs)
    assert out.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix_by_source(docs).collect())
    assert sum(words(r[1]) for r in out.collect()) == taken
    assert mixing.take(empty_docs(spark)).count() == 0


def test_documents_of_several_sources(spark):
    rng = random.Random(1)
    sets = [["a"], ["b"], ["a", "b"], ["b", "c"], ["c", "a", "a"], None, []]
    rows = [(i, prose(i, rng.randint(1, 60)), sets[i % len(sets)]) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>")
    _, mix = mixing.plan_mix(frame, "sources")
    plan = {r["_pattern"]: r for r in mix.collect()}
    assert set(plan) == {'["a"]', '["b"]', '["a","b"]', '["b","c"]', '["a","c"]', "[null]"}
    out = mixing.take(frame, "sources").collect()
    by_pattern: dict[str, int] = {}
    for r in out:
        key = "[" + ",".join(f'"{s}"' for s in sorted(set(r["sources"]))) + "]" if r["sources"] else "[null]"
        by_pattern[key] = by_pattern.get(key, 0) + words(r["text"])
    for p, r in plan.items():
        routed = sum(x["words"] for x in r["routes"])
        assert abs(by_pattern.get(p, 0) - routed) <= 5


def test_any_number_of_sources(spark):
    n = 100_100
    docs = spark.range(n).selectExpr("id AS doc_id", "repeat('a ', 10 + int(id % 7)) AS text", "concat('s', id) AS source")
    _, mix = mixing.plan_mix(docs)
    got = {r["routes"][0]["source"]: (r["routes"][0]["words"], r["source_size"], r["target"]) for r in mix.collect()}
    targets = mixing.source_targets({f"s{i}": 10 + i % 7 for i in range(n)})
    assert len(got) == n
    for i in range(n):
        target = targets[f"s{i}"]
        assert got[f"s{i}"] == (int(target), 10 + i % 7, float(target))


def test_parts_are_routed_as_the_whole(spark):
    sets = [["a"], ["a", "b"], ["b"], ["c", "d"], ["d"], ["d", "e"], ["f"], ["g"], None]
    rows = [(i, prose(i, 5 + i * i % 97), sets[i * i % 31 % len(sets)]) for i in range(500)]
    members, sizes, source_sizes = {}, {}, {}
    for _, text, sources in rows:
        key = "[" + ",".join(f'"{s}"' for s in sources) + "]" if sources else "[null]"
        members[key] = sources or [None]
        sizes[key] = sizes.get(key, 0) + words(text)
        for s in members[key]:
            source_sizes[s] = source_sizes.get(s, 0) + words(text)
    quotas = {s: int(t) for s, t in mixing.source_targets(source_sizes).items()}
    whole = mixing.route_words(sizes, members, quotas)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>")
    _, mix = mixing.plan_mix(frame, "sources")
    got = {r["_pattern"]: {x["source"]: x["words"] for x in r["routes"]} for r in mix.collect()}

    def result(flow):
        taken = [(p, sum(f for (x, _), f in flow.items() if x == p)) for p in sizes]
        return sum(flow.values()), sum(max(0, n - sizes[p]) for p, n in taken)

    parts = {(p, s): n for p, routes in got.items() for s, n in routes.items()}
    assert set(got) == set(sizes) and result(parts) == result(whole)
    assert all(sum(n for (_, x), n in parts.items() if x == s) <= quotas[s] for s in quotas)


def test_every_cell_can_hold_the_cut(spark, monkeypatch):
    # many small cells
    monkeypatch.setattr(mixing, "ROWS_EACH", 7)
    rows = [(i, prose(i, i % 23 + 1), "ab"[i % 2]) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_by_source(frame).collect()
    taken: dict = {}
    for r in got:
        s = "ab"[r["doc_id"] % 2]
        taken[s] = taken.get(s, 0) + r["taken"]
    for r in got:
        assert abs(taken["ab"[r["doc_id"] % 2]] - r["target"]) <= 2


def residual(patterns, members, quotas, routes, repeats=2):
    """What a flow leaves open: (from, to, cost) of every way that a word more could take."""
    arcs = []
    for p, words_of_p in patterns.items():
        taken = sum(routes.get((p, s), 0) for s in members[p])
        for k in range(repeats):
            used = min(max(taken - k * words_of_p, 0), words_of_p)
            arcs += [("start", p, k)] * (used < words_of_p) + [(p, "start", -k)] * (used > 0)
        for s in members[p]:
            arcs += [(p, ("s", s), 0)] + [(("s", s), p, 0)] * (routes.get((p, s), 0) > 0)
    for s, quota in quotas.items():
        got = sum(f for (_, x), f in routes.items() if x == s)
        assert got <= quota
        arcs += [(("s", s), "goal", 0)] * (got < quota) + [("goal", ("s", s), 0)] * (got > 0)
    return arcs


def test_overlapping_sources_get_the_cheapest_of_the_largest_flows(spark, sf_dir):
    """No word more can be routed, and no routed word can go a cheaper way: the two marks of such a flow."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    rows = QUERIES["mixing_overlaps"](spark, sf_dir).collect()
    sets = {r["doc_id"]: sorted(f"{k}:{r[k]}" for k in ("source", "lang") if r[k] is not None) for r in docs}
    sizes = {r["doc_id"]: words(r["text"]) for r in docs}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes and len(rows) == len(docs)
    patterns, members, routes, taken = {}, {}, {}, {}
    for r in rows:
        p = r["pattern"]
        assert p == json.dumps(sets[r["doc_id"]] or [None], separators=(",", ":"), ensure_ascii=False)
        members[p] = sets[r["doc_id"]] or [None]
        patterns[p] = patterns.get(p, 0) + r["size"]
        taken[p] = taken.get(p, 0) + r["taken"]
        routes.update({(p, x["source"]): x["words"] for x in r["routes"]})
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    source_sizes = {}
    for p, sources in members.items():
        for s in sources:
            source_sizes[s] = source_sizes.get(s, 0) + patterns[p]
    quotas = {s: int(t) for s, t in mixing.source_targets(source_sizes).items()}
    assert len(members) > len(source_sizes) > 4
    arcs = residual(patterns, members, quotas, routes)
    nodes = {x for a, b, _ in arcs for x in (a, b)}
    reached = {"start"}
    for _ in nodes:
        reached |= {b for a, b, _ in arcs if a in reached}
    assert "goal" not in reached
    cost = dict.fromkeys(nodes, 0)
    for _ in range(len(nodes) + 1):
        better = [(b, cost[a] + c) for a, b, c in arcs if cost[a] + c < cost[b]]
        for b, c in better:
            cost[b] = min(cost[b], c)
    assert not better
    # whole documents come near the words that the flow takes of each pattern
    for p in patterns:
        wanted = sum(routes.get((p, s), 0) for s in members[p])
        assert abs(taken[p] - wanted) <= max(0.05 * patterns[p], 40)
