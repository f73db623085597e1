"""Language identification by rank-order profiles.

A profile is the list of a language's ``PROFILE`` most frequent letter n-grams (1 to 3 letters, words padded by a blank), by
rank. A document's own most frequent n-grams are compared to each profile by out-of-place distance: the sum of the
differences of rank, ``PROFILE`` for an n-gram that the profile lacks. The nearest profile is the language.

Letters are lower-cased and numbered: a-z and the letters of Latin-1 each by themselves, all others folded to the numbers
that are left. Profiles count the n-grams of all documents that are not held out; ties of counts go to the smaller n-gram
code, ties of distance to the smaller language by code point.

A text that is null or has no letter gets ``und`` and score 0. Without any document to learn from, every text gets ``und``.
A text of any length is read whole and is a slice of its own where it is longer than one; it takes about 40 bytes for each letter.
Rows with null lang are not learned from, but predicted. Repeated rows count each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.batches import documents, map_arrow, own_columns, slices

PROFILE = 400
ALPHABET = 128
# languages that a task counts before it sends its counts on; about 17 MB each
COUNTED_AT_ONCE = 6
_PLACES = 1 << 12


def _letter_table() -> np.ndarray:
    """Number of each letter of the first code points: 0 for what is no letter."""
    table = np.zeros(_PLACES, np.int32)
    for code in range(_PLACES):
        if chr(code).isalpha():
            table[code] = _number(code)
    return table


def _number(code: int) -> int:
    if 97 <= code <= 122:
        return code - 96
    if 0xDF <= code <= 0xFF:
        return 27 + code - 0xDF
    return 60 + code % 68


_LETTERS = _letter_table()


def letter_numbers(text: str) -> np.ndarray:
    """Numbers of the letters in order, one 0 around and between runs of letters; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) and codes.max() >= _PLACES:
        out = np.zeros(len(codes), np.int32)
        low = codes < _PLACES
        out[low] = _LETTERS[codes[low]]
        high = np.unique(codes[~low])
        numbers = np.array([_number(int(c)) if chr(c).isalpha() else 0 for c in high], np.int32)
        out[~low] = numbers[np.searchsorted(high, codes[~low])]
    else:
        out = _LETTERS[codes]
    out = np.concatenate([[0], out, [0]]).astype(np.int32)
    # runs of zeros become one
    out = out[(out > 0) | np.concatenate([[True], out[:-1] > 0])]
    return out if out.any() else out[:0]


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 letters; a longer one may hold the blank at a word's edge, at its ends only."""
    x = letter_numbers(text)
    if not len(x):
        return x
    two = x[:-1] * ALPHABET + x[1:] + ALPHABET * ALPHABET * 2
    three = (x[:-2] * ALPHABET + x[1:-1]) * ALPHABET + x[2:] + ALPHABET * ALPHABET * 4
    return np.concatenate([x[x > 0], two, three[x[1:-1] > 0]])


def top_grams(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams by rank."""
    codes = grams(text)
    codes.sort()
    at = np.flatnonzero(np.diff(codes, prepend=-1))
    counts = np.diff(np.append(at, len(codes)))
    found = codes[at]
    if len(found) > size:
        # ties at the edge are sorted out below
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        found, counts = found[keep], counts[keep]
    return found[np.argsort(-counts, kind="stable")[:size]]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language of this task; languages and n-gram codes are bounded, documents are not held."""
    counts: dict[str, np.ndarray] = {}
    span = ALPHABET**3 + 4 * ALPHABET**2
    for batch in slices(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            codes = [grams(texts[i]) for i in np.flatnonzero(langs == lang) if texts[i]]
            if codes:
                counts.setdefault(lang, np.zeros(span, np.int64))
                counts[lang] += np.bincount(np.concatenate(codes), minlength=span)
        if len(counts) > COUNTED_AT_ONCE:
            yield from _counted(counts)
            counts = {}
    yield from _counted(counts)


def _counted(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, n in counts.items():
        codes = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n[codes])], names=["lang", "gram", "n"]
        )


def profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """The profile of each language, from all documents that are not held out."""
    rows = own_columns(docs, "doc_id", "lang", "text")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    counted = map_arrow(rows, _count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at most ALPHABET ** 3 n-grams for each language
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROFILE)
    out: dict[str, list] = {}
    for row in ranked.orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(x, np.int64) for lang, x in out.items()}


class RankModel:
    def __init__(self, found: dict[str, np.ndarray]):
        self.langs = sorted(found)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *found.values()]))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, found[lang])] = np.arange(len(found[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how near it is: 1 for no distance, 0 if no n-gram is shared."""
        top = top_grams(text or "")
        if not len(top) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        ranks = self.ranks[:, at]
        off = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(off))
        return self.langs[best], 1 - float(off[best]) / (PROFILE * len(top))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = RankModel(profiles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = zip(*map(model.predict, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    rows = map_arrow(documents(docs), run, "doc_id bigint, lang_pred string, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
