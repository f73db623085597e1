"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded by a small network from shares of
character classes and word shapes; gated attention weighs the passages of a document, and the weighted mean of their
codes gives the score. Only documents have labels: the weights of the passages are learned from them.

The model is fitted on a bounded sample of labelled rows: documents in the order of the hashes of their numbers, ``SAMPLE_DOCS`` of
them at most, each with all its passages, as far as all passages together are ``SAMPLE_PASSAGES`` at most (a document that would
exceed this is passed over). Scoring reads whole texts. A text longer than ``TEXT_BYTES`` is encoded alone, in chunks that end with a
passage, so a task holds the numbers of one chunk and 200 bytes for each passage of the text.

A null or empty text is one passage of zeros and gets the score that this has. Several labels of one document are
averaged, labels that are null are left out. If no labels of both kinds exist, every score is the share of label 1 (one half
without labels). Repeated rows are scored each. Extra columns are not read, or kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftmark.llm.batches import byte_texts, documents, map_arrow, own_columns, set_aside, slices, text_key
from weftmark.session import materialize

PASSAGE_WORDS = 100
# bytes of text encoded at a time; each takes up to a hundred bytes of numbers
TEXT_BYTES = 1 << 20
SAMPLE_DOCS = 4000
SAMPLE_PASSAGES = 100_000
HIDDEN = 16
ATTENTION = 8
EPOCHS = 300
RATE = 0.02
DECAY = 1e-3
SEED = 3
CUT = 0.3

# classes of bytes: 0 white space, 1 a-z, 2 A-Z, 3 digits, 4 beyond ASCII, 5 control, then each sign by itself
_CLASS = np.full(256, 5, np.int64)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 4
_SIGNS = [c for c in range(33, 127) if _CLASS[c] == 5]
_CLASS[_SIGNS] = range(6, 6 + len(_SIGNS))
_CLASSES = 6 + len(_SIGNS)
WIDTH = _CLASSES + 9


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One row of shares for each passage, and the number of passages of each text (one at least)."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    kind = _CLASS[data]
    space = kind == 0
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    closes = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    text_of = np.searchsorted(ends, begins, side="right")
    counts = np.bincount(text_of, minlength=len(texts))
    place = np.arange(len(begins)) - (np.cumsum(counts) - counts)[text_of]
    passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.cumsum(passages) - passages
    total = int(passages.sum())
    of_word = first[text_of] + place // PASSAGE_WORDS
    # a passage begins with its text or with its first word
    marks = np.zeros(len(data), np.int64)
    marks[ends[:-1]] = 1
    marks[begins[(place > 0) & (place % PASSAGE_WORDS == 0)]] = 1
    of_byte = np.cumsum(marks)
    classes = np.bincount(of_byte * _CLASSES + kind, minlength=total * _CLASSES).reshape(total, _CLASSES).astype(np.float64)
    words = np.bincount(of_word, minlength=total).astype(np.float64)
    lengths = (closes - begins).astype(np.float64)
    safe = np.maximum(words, 1)

    def share(values: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, values, total) / safe

    mean = share(lengths)
    spread = np.sqrt(np.maximum(share(lengths**2) - mean**2, 0))
    last, head = kind[closes - 1], kind[begins]
    # repeats: words whose length, first, last and middle bytes came before in the passage
    middle = data[(begins + closes) // 2].astype(np.int64)
    shape = ((of_word * 64 + np.minimum(closes - begins, 63)) * 256 + data[begins]) * 256 + data[closes - 1]
    shape = shape * 256 + middle
    _, seen = np.unique(shape, return_index=True)
    fresh = np.zeros(len(begins))
    fresh[seen] = 1
    features = np.column_stack([
        classes / np.maximum(classes.sum(axis=1, keepdims=True), 1),
        mean / 10, spread / 10, share((last >= 6).astype(float)), share((head == 2).astype(float)), share((head >= 6).astype(float)),
        share(((last >= 6) & (lengths == 1)).astype(float)), share((lengths <= 3).astype(float)), share(fresh), np.log1p(words) / 5,
    ])
    return np.sqrt(np.abs(features)), passages


def chunks(text: bytes, limit: int = TEXT_BYTES) -> Iterator[bytes]:
    """Parts of a text, each of whole passages but for the last; longer than ``limit`` only where a passage is."""
    at, size = 0, limit
    while len(text) - at > size:
        part = np.frombuffer(text, np.uint8, size, at)
        space = _CLASS[part] == 0
        begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        # the first word after the last whole passage
        place = (len(begins) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
        if place > 0:
            # the last byte is white space, which encoding adds to every text
            yield text[at : at + begins[place] - 1]
            at, size = at + int(begins[place]), limit
        else:
            size *= 2
    yield text[at:]


def encode_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``encode_passages``, long texts in chunks."""
    if all(len(t) <= TEXT_BYTES for t in texts):
        return encode_passages(texts)
    codes, counts = [], []
    for text in texts:
        parts = [encode_passages([part])[0].astype("<f4") for part in chunks(text)]
        codes += parts
        counts.append(sum(map(len, parts)))
    return np.concatenate(codes), np.array(counts)


class AttentionModel:
    """Gated attention over passage codes; parameters are a few thousand numbers."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        n = len(mean)
        self.p = {
            "w": rng.normal(0, n**-0.5, (n, HIDDEN)), "b": np.zeros(HIDDEN),
            "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "a": rng.normal(0, ATTENTION**-0.5, ATTENTION), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }
        self.prior: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray):
        p, starts = self.p, np.cumsum(counts) - counts
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        bag = np.add.reduceat(h * weight[:, None], starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["d"], -30, 30)))
        return score, (z, h, t, g, weight, bag, starts)

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), self.prior) if self.prior is not None else self.forward(x, counts)[0]

    def gradients(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (z, h, t, g, weight, bag, _) = self.forward(x, counts)
        off = (score - labels) * weights
        d_bag = np.repeat(off[:, None] * p["c"], counts, axis=0)
        d_weight = (d_bag * h).sum(axis=1)
        d_e = weight * (d_weight - np.repeat(off * (bag @ p["c"]), counts))
        d_tg = d_e[:, None] * p["a"]
        d_t, d_g = d_tg * g * (1 - t**2), d_tg * t * g * (1 - g)
        d_h = d_bag * weight[:, None] + d_t @ p["v"].T + d_g @ p["u"].T
        d_z = d_h * (1 - h**2)
        return {
            "w": z.T @ d_z, "b": d_z.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_g, "a": (t * g).T @ d_e,
            "c": bag.T @ off, "d": np.array([off.sum()]),
        }


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> AttentionModel:
    """Fit by Adam on all sample bags at once."""
    if not len(labels) or labels.min() == labels.max():
        model = AttentionModel(np.zeros(WIDTH), np.ones(WIDTH))
        model.prior = float(labels.mean()) if len(labels) else 0.5
        return model
    model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 1e-3)
    weights = np.full(len(labels), 1 / len(labels))
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for i in range(1, EPOCHS + 1):
        rate = RATE * min(1, 2 * (1 - (i - 1) / EPOCHS))
        for k, grad in model.gradients(x, counts, labels, weights).items():
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            step = first[k] / (1 - 0.9**i) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
            model.p[k] -= rate * (step + DECAY * model.p[k])
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=TEXT_BYTES):
        x, counts = encode_texts(byte_texts(batch))
        ends = np.cumsum(counts)
        out = [x[end - n : end].astype("<f4").tobytes() for end, n in zip(ends, counts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(counts), pa.array(out, pa.binary())],
            names=["doc_id", "label", "n", "x"],
        )


def fit(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """The model of ``quality`` from labels of documents that are not held out."""
    sample = (
        own_columns(labels, "doc_id", "quality")
        .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_DOCS)
    )
    # the sample is bounded, so it may go to every task
    rows = documents(docs).join(F.broadcast(sample), "doc_id")
    # one row of each sampled document, whatever its repeats
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(text_key().alias("key"), "text")).alias("least"))
    rows = rows.select("doc_id", "label", "least.text")
    rows = map_arrow(rows.select("doc_id", "label", "text"), _encode, "doc_id bigint, label double, n bigint, x binary")
    rows = materialize(rows, "sample-passages")
    # which documents fit is decided by their sizes; only these come to the driver
    chosen, passages = [], 0
    for row in sorted(rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "n").collect()):
        if passages + row["n"] <= SAMPLE_PASSAGES:
            passages += row["n"]
            chosen.append(row["doc_id"])
    got = sorted(rows.where(F.col("doc_id").isin(chosen)).select("doc_id", "label", "x").collect(), key=lambda r: r["doc_id"])
    if not got:
        return train(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0))
    bags = [np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in got]
    counts = np.array([len(b) for b in bags])
    return train(np.concatenate(bags).astype(float), counts, np.array([r["label"] for r in got]))


def _score(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            score = model.scores(*encode_texts(byte_texts(batch)))
            kept = [batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*batch.schema.names, "_score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scored in _score(model)(batches):
            yield scored.select(["doc_id", "_score"])

    rows = map_arrow(documents(docs), run, "doc_id bigint, _score double")
    return rows.select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is ``CUT`` or more, with their own columns."""
    rows, restore = set_aside(docs, "doc_id", "text")
    scored = map_arrow(rows, _score(fit(docs, labels)), StructType([*rows.schema.fields, StructField("_score", DoubleType())]))
    return restore(scored.where(F.col("_score") >= CUT))
