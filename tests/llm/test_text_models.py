from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import accumulate

import numpy as np
import pytest
from edges import edge_docs, edge_rows, empty_docs, multiset, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmark.llm import language, quality, secrets
from weftmark.llm.queries import QUERIES

PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)


def base_spans(text):
    """Spans of the fixed patterns as (start, kind, end)."""
    spans = []
    for kind, (_, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if (len(m[2]) >= 6, len(m[0]) >= 20, len(m[0]) >= 24)[kind] if kind == 0 else len(m[0]) >= (0, 20, 24)[kind]:
                spans.append((m.start(), kind, m.end()))
    return sorted(spans)


def written(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check_scan(rows, docs):
    want = []
    for doc, text in docs:
        spans = base_spans(text)
        want.append((doc, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(written(spans).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows]
    assert multiset(got) == multiset(want)
    for r in rows:
        spans = r["spans"].split(",") if r["spans"] else []
        base = [s for s in spans if not s.startswith("random")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
        assert len(spans) - len(base) == r["n_random"]


def test_secrets_of_edge_documents(spark):
    rows = secrets.scan(edge_docs(spark)).collect()
    check_scan(rows, [r[:2] for r in edge_rows()])
    assert secrets.scan(empty_docs(spark)).count() == 0


def test_op2_equals_patterns_one_by_one(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_scan(QUERIES["op2_secrets"](spark, sf_dir).collect(), docs)


def ordinary_and_random():
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(50)]
    keys += ["".join(rng.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(50)]
    words = [prose(i, 6).replace(" ", "_-/"[i % 3]) + "_settings_of_the_main_table" for i in range(100)]
    return keys, words


def test_models_tell_random_strings_from_identifiers(spark):
    prose_docs = spark.createDataFrame([(i, prose(i, 300) + " the settings of the main table") for i in range(60)], "doc_id bigint, text string")
    ratios = secrets.train_ratios(secrets.sample_strings(prose_docs))
    keys, words = ordinary_and_random()
    frame = spark.createDataFrame([(i, f"Some text {w} goes on.") for i, w in enumerate(keys + words)], "doc_id bigint, text string")
    found = secrets.with_spans(frame, ratios).select("doc_id", F.size("_spans").alias("n")).collect()
    hits = {r["doc_id"]: r["n"] for r in found}
    assert sum(hits[i] == 1 for i in range(100)) >= 98
    assert sum(hits[100 + i] for i in range(100)) <= 1


def test_no_secret_survives_redaction(spark):
    keys, _ = ordinary_and_random()
    docs = edge_docs(spark)
    more = spark.createDataFrame([(100 + i, f"é {k}, {prose(i, 80)} token={k}", "en", "web", 1, *["x"] * 10) for i, k in enumerate(keys[:20])], docs.schema)
    both = docs.union(more)
    out = secrets.redact(both)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == both.count()
    for r in rows:
        text = r[1] or ""
        assert not base_spans(text) and not any(k in text for k in keys)
        if secrets.MASK in text:
            assert r[4] == len(text)
    untouched = {r[:2] for r in edge_rows() if r[1] and not base_spans(r[1])}
    assert untouched <= {tuple(r)[:2] for r in rows}


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
@settings(max_examples=10, deadline=None)
def test_running_sums(spark, values):
    got = []
    for block in (3, 512):
        old, secrets._BLOCK = secrets._BLOCK, block
        column = F.array(*(F.lit(v).cast("bigint") for v in values))
        got.append(spark.range(1).select(secrets.running_sums(column)).first()[0])
        secrets._BLOCK = old
    assert got == [list(accumulate(values))] * 2


def test_plan_of_the_scan_has_no_python(spark, sf_dir):
    plan = QUERIES["op2_secrets"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def crc(doc):
    return zlib.crc32(str(doc).encode())


def test_quality_of_held_out_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(tested) > 5
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in tested]) >= 0.95


def edge_labels(spark, values):
    return spark.createDataFrame([(d, v, "x") for d, v in values], "doc_id bigint, quality int, score string")


@pytest.mark.parametrize("values", [[], [(6, 1)], [(i, i % 2) for i in range(1, 19)] + [(None, 1), (5, None), (6, 0), (6, 1), (99, 1)]])
def test_quality_of_edge_documents(spark, values):
    docs = edge_docs(spark)
    rows = quality.score(docs, edge_labels(spark, values)).collect()
    assert len(rows) == len(edge_rows())
    assert all(0 <= r["score"] <= 1 for r in rows)
    # equal texts, equal scores
    kept = quality.keep_good(docs, edge_labels(spark, values))
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score(empty_docs(spark), edge_labels(spark, values)).count() == 0


def test_passages_are_those_of_texts_alone():
    texts = [(r[1] or "").encode() for r in edge_rows()]
    together, counts = quality.encode_passages(texts)
    at = 0
    for text, n in zip(texts, counts):
        alone, one = quality.encode_passages([text])
        assert one.tolist() == [n] and n == max(1, -(-len(text.split()) // quality.PASSAGE_WORDS))
        assert np.allclose(alone, together[at : at + n])
        at += n
    assert at == len(together)


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(2)
    x, counts, labels = rng.normal(size=(9, quality.WIDTH)), np.array([2, 4, 3]), np.array([0.0, 1.0, 1.0])
    model, weights = quality.AttentionModel(np.zeros(quality.WIDTH), np.ones(quality.WIDTH)), np.full(3, 1 / 3)

    def loss():
        score = model.forward(x, counts)[0]
        return -(weights * (labels * np.log(score) + (1 - labels) * np.log(1 - score))).sum()

    grads = model.gradients(x, counts, labels, weights)
    for name, values in model.p.items():
        for at in rng.choice(values.size, min(5, values.size), replace=False):
            old = values.flat[at]
            values.flat[at] = old + 1e-5
            up = loss()
            values.flat[at] = old - 1e-5
            down = loss()
            values.flat[at] = old
            assert abs((up - down) / 2e-5 - grads[name].flat[at]) < 1e-6


def test_one_bad_passage_decides_in_a_long_document():
    # bags with one telling passage among many: the mean hides it, attention finds it
    rng = np.random.default_rng(5)
    bags, labels = [], []
    for i in range(400):
        bag = rng.normal(size=(20, quality.WIDTH))
        if i % 2:
            bag[rng.integers(20), :3] += 5
        bags.append(bag)
        labels.append(float(i % 2))
    counts = np.full(400, 20)
    model = quality.train(np.concatenate(bags[:300]), counts[:300], np.array(labels[:300]))
    scores = model.scores(np.concatenate(bags[300:]), counts[300:])
    assert np.mean((scores >= 0.5) == np.array(labels[300:])) > 0.9


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()
    langs = dict(map(tuple, docs))
    rows = QUERIES["op7_language"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in tested]) >= 0.97


def test_language_of_edge_documents(spark):
    rows = language.identify(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r["lang_pred"] in ("en", "fr", "und")
    texts = {r[0]: r[1] for r in edge_rows()}
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {1, 2, 3} <= und and not und & {4, 5, 6, 10}
    assert all(not any(c.isalpha() for c in texts[d] or "") for d in und if d is not None)
    assert language.identify(empty_docs(spark)).count() == 0
    unlearned = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlearned).collect()} == {"und"}


def plain_grams(text):
    """Counts of n-grams of letter numbers, words padded by one blank."""
    counts: dict[tuple, int] = {}
    words = re.findall(r"[^\W\d_]+", text.lower())
    for w in (w for w in words if all(c.isalpha() for c in w)):
        x = [language._number(ord(c)) for c in w]
        padded = [0, *x, 0]
        for g in [(c,) for c in x] + [tuple(padded[i : i + n]) for n in (2, 3) for i in range(len(padded) - n + 1)]:
            counts[g] = counts.get(g, 0) + 1
    return counts


def gram_code(g):
    a = language.ALPHABET
    return (g[0], *(g[0] * a + g[1] + 2 * a * a for _ in g[1:2]), *((g[0] * a + g[1]) * a + g[2] + 4 * a * a for _ in g[2:3]))[len(g) - 1]


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], gram_code(g)))[:size]


def test_op7_equals_plain_profiles(spark, sf_dir):
    """Every document of the smallest table: profiles counted gram by gram, and distances rank by rank."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    totals: dict[str, dict] = {}
    own = {r["doc_id"]: plain_grams(r["text"] or "") for r in docs}
    for r in docs:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            learned = totals.setdefault(r["lang"], {})
            for g, n in own[r["doc_id"]].items():
                learned[g] = learned.get(g, 0) + n
    profiles = {lang: {g: i for i, g in enumerate(ranked(counts, language.PROFILE))} for lang, counts in totals.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op7_language"](spark, sf_dir).collect()}
    for r in docs:
        top = ranked(own[r["doc_id"]], language.PROFILE)
        if not top:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        off = {
            lang: sum(abs(profile[g] - i) if g in profile else language.PROFILE for i, g in enumerate(top)) for lang, profile in profiles.items()
        }
        best = min(sorted(off), key=off.get)
        assert got[r["doc_id"]] == (best, pytest.approx(1 - off[best] / (language.PROFILE * len(top))))


@pytest.mark.parametrize("text", ["a", "ab ba ab", "Straße, ÄÖÜ 12 été", "мир и 你好", prose(3, 400)])
def test_top_grams_are_the_most_frequent(text):
    counts = {gram_code(g): n for g, n in plain_grams(text).items()}
    want = sorted(counts, key=lambda c: (-counts[c], c))[:50]
    assert language.top_grams(text, 50).tolist() == want


def test_a_repeated_document_is_sampled_once(spark, monkeypatch):
    from weftmark.llm import quality

    bags = []
    monkeypatch.setattr(quality, "train", lambda x, counts, labels: bags.append(len(labels)))
    rows = [(i, f"text {i}") for i in range(40)] + [(i, f"other {j}") for i in range(40) for j in range(20)]
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "doc_id bigint, quality double")
    quality.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    assert bags == [labels.where(~quality.held_out()).count()]


def plain_passages(text):
    """Shares of the passages of a text, byte by byte and word by word."""
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    cuts = [spans[i][0] for i in range(quality.PASSAGE_WORDS, len(spans), quality.PASSAGE_WORDS)]
    data = text + b"\n"
    out = []
    for lo, hi in zip([0, *cuts], [*cuts, len(data)]):
        kinds = [int(quality._CLASS[c]) for c in data[lo:hi]]
        shares = [kinds.count(k) / max(len(kinds), 1) for k in range(quality._CLASSES)]
        words = [text[a:b] for a, b in spans if lo <= a < hi]
        n = max(len(words), 1)
        lengths = [len(w) for w in words]
        mean = sum(lengths) / n
        spread = max(sum(x * x for x in lengths) / n - mean**2, 0) ** 0.5
        last, head = ([int(quality._CLASS[w[i]]) for w in words] for i in (-1, 0))
        seen, fresh = set(), 0
        for (a, b), w in zip([s for s in spans if lo <= s[0] < hi], words):
            shape = min(len(w), 63), w[0], w[-1], data[(a + b) // 2]
            fresh += shape not in seen
            seen.add(shape)
        rest = [
            mean / 10, spread / 10, sum(x >= 6 for x in last) / n, sum(x == 2 for x in head) / n, sum(x >= 6 for x in head) / n,
            sum(x >= 6 and m == 1 for x, m in zip(last, lengths)) / n, sum(m <= 3 for m in lengths) / n, fresh / n,
            math.log1p(len(words)) / 5,
        ]
        out.append([x**0.5 for x in shares + rest])
    return np.array(out)


def plain_score(model, rows):
    """Gated attention, passage by passage."""
    p = model.p
    codes, pulls = [], []
    for row in rows:
        z = [max(-6.0, min(6.0, (x - m) / s)) for x, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(a * b for a, b in zip(z, w)) + b0) for w, b0 in zip(p["w"].T, p["b"])]
        gates = [
            math.tanh(sum(a * b for a, b in zip(h, v))) / (1 + math.exp(-sum(a * b for a, b in zip(h, u)))) for v, u in zip(p["v"].T, p["u"].T)
        ]
        codes.append(h)
        pulls.append(sum(a * b for a, b in zip(gates, p["a"])))
    weights = [math.exp(e - max(pulls)) for e in pulls]
    bag = [sum(w * h[k] for w, h in zip(weights, codes)) / sum(weights) for k in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(bag, p["c"])) + p["d"][0])))


def test_op3_scores_equal_a_plain_forward_pass(spark, sf_dir, monkeypatch):
    """Every document of the smallest tables, by the model that the query fits."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "fit", lambda docs, labels: model)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    for row in docs.collect():
        rows = plain_passages((row["text"] or "").encode())
        assert got[row["doc_id"]] == pytest.approx(plain_score(model, rows), abs=1e-9)


@pytest.mark.parametrize("limit", [40, 700, 5000])
def test_chunks_are_whole_passages(limit):
    texts = [prose(1, 20_000).encode(), b"x" * 9000, b"a " * 4000, b"  " + prose(2, 350).encode() + b" \n ", b"\xc3\xa9 " * 1500, b" " * 5000]
    for text in texts:
        parts = list(quality.chunks(text, limit))
        coded = np.concatenate([quality.encode_passages([p])[0] for p in parts])
        assert np.allclose(coded, quality.encode_passages([text])[0])
        assert b" ".join(b" ".join(p.split()) for p in parts if p.split()) == b" ".join(text.split())


def test_fit_uses_all_passages_and_bounds_them_by_whole_documents(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "train", lambda x, counts, labels: sizes.append(counts.tolist()))
    words = {i: 100 * (1 + i % 7) for i in range(40)}
    docs = spark.createDataFrame([(i, prose(i, n)) for i, n in words.items()], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "doc_id bigint, quality double")
    quality.fit(docs, labels)
    fitted = [r["doc_id"] for r in labels.where(~quality.held_out()).orderBy("doc_id").collect()]
    assert sizes[0] == [words[i] // 100 for i in fitted]
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 30)
    quality.fit(docs, labels)
    assert 24 <= sum(sizes[1]) <= 30 and len(sizes[1]) < len(sizes[0])


def test_text_of_20_mb(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    long = prose(3, 4000)
    text = " ".join([long] * (20_000_000 // len(long)))
    rows = spark.createDataFrame([(-1, text), (-2, long), (-3, None)], "doc_id bigint, text string")
    everything = docs.select("doc_id", "text").unionByName(rows)
    got = {r["doc_id"]: r["score"] for r in quality.score(everything, labels).where("doc_id < 0").collect()}
    # many copies of a text have nearly its passages
    assert got[-1] == pytest.approx(got[-2], abs=0.05)
    kept = {r["doc_id"] for r in quality.keep_good(everything, labels).where("doc_id < 0").select("doc_id").collect()}
    assert kept == {d for d, s in got.items() if s >= quality.CUT}
