"""Each stage of the pipeline next to a plain version that starts from what the stage before wrote."""

from __future__ import annotations

import numpy as np
from edges import empty_docs, multiset
from test_duplicates import plain_components
from test_mixing import words
from test_text_models import base_spans
from test_tokens import check_packed
from tokenizers import Tokenizer

import corpus_pipeline
from weftmark.llm import mixing, quality, secrets
from weftmark.llm.queries import tokenizer_file
from weftmark.session import materialize


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert names == ["quality_classifier", "simhash_near_dedup", "secret_scans", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = {}
    for name in names:
        docs = materialize(stages[name](spark, docs, sf_dir), name)
        held[name] = docs
        assert name == names[-1] or docs.columns == columns

    # quality: the rejected documents go, the clean ones stay
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    predicted = {r["doc_id"]: r["predicted"] for r in quality.score(source, labels).collect()}
    want = [tuple(r) for r in source.collect() if predicted[r["doc_id"]]]
    good = [tuple(r) for r in held["quality_classifier"].collect()]
    assert multiset(good) == multiset(want)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert not any(marks.get(r[0]) == 0 for r in good)
    assert np.mean([predicted[d] for d, q in marks.items() if q == 1]) > 0.97

    # near duplicates: the first of each group
    names_of = {c for _, _, c in plain_components([r[:2] for r in good])}
    single = [tuple(r) for r in held["simhash_near_dedup"].collect()]
    assert multiset(single) == multiset(r for r in good if r[0] in names_of)

    # secrets: none is left, other texts are as they were
    safe = {r[0]: tuple(r) for r in held["secret_scans"].collect()}
    assert set(safe) == {r[0] for r in single}
    for r in single:
        assert not base_spans(safe[r[0]][1])
        assert safe[r[0]] == r or secrets.MASK in safe[r[0]][1]

    # mix: whole documents, twice at most, near the targets
    mixed = [tuple(r) for r in held["source_mixing"].collect()]
    copies: dict[int, int] = {}
    for r in mixed:
        assert r == safe[r[0]]
        copies[r[0]] = copies.get(r[0], 0) + 1
    assert max(copies.values()) == 2
    sizes, taken = {}, {}
    for r in safe.values():
        n = words(r[1])
        sizes[r[3]] = sizes.get(r[3], 0) + n
        taken[r[3]] = taken.get(r[3], 0) + n * copies.get(r[0], 0)
    for s, target in mixing.source_targets(sizes).items():
        # few documents are left of each source here
        assert abs(taken[s] - target) <= max(0.1 * sizes[s], 30)

    tokenizer = Tokenizer.from_file(tokenizer_file())
    plain = lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
    check_packed(held["best_fit_packing"].collect(), [r[:2] for r in mixed], plain)


def test_run_has_the_rows_of_its_stages(spark, sf_dir):
    one, two = (multiset(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert one == two and one
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_no_documents(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), sf_dir).count() == 0
