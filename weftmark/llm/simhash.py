"""SimHash near-duplicates by segment popcounts.

A fingerprint is mapped to the bit counts of its two-bit segments. The Manhattan distance of two such count vectors never
exceeds the Hamming distance of the fingerprints, so fingerprints within ``MAX_BITS`` bits lie within ``MAX_BITS`` of each
other there. The segments are dealt to ``GROUPS`` groups; in one group at least the distance is then
``MAX_BITS // GROUPS`` or less. In each group the count vectors are cells of a grid of width one: every fingerprint stands
in its cell and is also sent to the cells one step up, so that a pair within one step meets in a cell. Pairs that meet are
verified by their exact Hamming distance.

Only distinct fingerprints take part. A cell gives the links of a spanning forest of its fingerprints, not all pairs; a
cell of over ``CELL_ROWS`` rows is cut into blocks, and each pair of blocks is a unit of work of its own.

Words are runs of other characters than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z are
lower-cased. A text of any length is read whole, a long one alone, with some 60 bytes for each word. A text without words (null, empty) has fingerprint zero and is linked like any other. Rows with a null doc_id
take part, but never name a component unless all of its rows have none. Extra columns are not read. An empty input gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.batches import byte_texts, documents, map_arrow, set_aside, slices, text_key
from weftmark.llm.components import components
from weftmark.session import materialize

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
GROUPS = 3
SEGMENTS = 32
CELL_ROWS = 8192
# bytes of text hashed at a time
TEXT_BYTES = 2 << 20
# pairs compared at once
BLOCK_PAIRS = 1 << 18

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, words_each: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every shingle; of the whole sequence if it has fewer words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return [digest(joined, HASH_SEED)]
    return [digest(joined[a : b - 1], HASH_SEED) for a, b in zip(starts, ends[words_each - 1 :])]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits that are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    of = np.repeat(np.arange(len(counts)), counts)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        seen = np.bincount(of * 256 + octets[:, k], minlength=256 * len(counts)).reshape(-1, 256)
        bits = (2 * (seen @ _BITS) > counts[:, None]).astype(np.uint8)
        out |= np.packbits(bits, axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=TEXT_BYTES):
        lists = [shingle_hashes(t) for t in byte_texts(batch)]
        counts = np.array([len(x) for x in lists], np.int64)
        hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(majority_bits(hashes, counts).view(np.int64))],
            names=["doc_id", "row_key", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and fingerprint of every row."""
    rows = documents(docs).select("doc_id", text_key().alias("row_key"), "text")
    return map_arrow(rows, _fingerprints, "doc_id bigint, row_key bigint, fp bigint")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = np.array_split(np.arange(SEGMENTS), GROUPS)
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        counts = np.stack([np.bitwise_count(fp >> np.uint64(2 * s) & np.uint64(3)) for s in range(SEGMENTS)], axis=1).astype(np.int64)
        cells, rows = [], []
        for g, segments in enumerate(groups):
            steps = 3 ** np.arange(len(segments), dtype=np.int64)
            home = counts[:, segments] @ steps + g * 3 ** (SEGMENTS // GROUPS + 1)
            cells.append(home)
            rows.append(np.arange(len(fp)))
            for segment, step in zip(segments, steps):
                up = np.flatnonzero(counts[:, segment] < 2)
                cells.append(home[up] + step)
                rows.append(-1 - up)
        at = np.concatenate(rows)
        resident = at >= 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(cells)), pa.array(fp.view(np.int64)[np.where(resident, at, -1 - at)]), pa.array(resident)],
            names=["cell", "fp", "resident"],
        )


def forest(resident: np.ndarray, rest: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within ``max_bits`` of a resident connect; as many as fingerprints at most."""
    everyone = np.concatenate([resident, rest])
    if len(resident) * len(everyone) <= BLOCK_PAIRS:
        near = np.bitwise_count(resident[:, None] ^ everyone[None, :]) <= max_bits
        i, j = np.nonzero(near)
        keep = resident[i] != everyone[j]
        i, j = i[keep], j[keep]
        if len(i) <= len(everyone):
            return resident[i], everyone[j]
    a, b = [], []
    left = np.unique(everyone)
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), at))
                b.append(found)
                reached.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (everyone[:0], everyone[:0])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every unit; the rows of a unit follow each other."""

    def links(unit: np.ndarray, fp: np.ndarray, resident: np.ndarray):
        cuts = np.flatnonzero(np.diff(unit)) + 1
        a, b = [], []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)]):
            home = resident[lo:hi]
            if hi - lo > 1 and home.any():
                x, y = forest(fp[lo:hi][home], fp[lo:hi][~home])
                if len(x):
                    a.append(x)
                    b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"]
            )

    held = None
    for batch in batches:
        now = (
            batch.column("unit").to_numpy(), batch.column("fp").to_numpy().view(np.uint64),
            batch.column("resident").to_numpy(zero_copy_only=False),
        )
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        # the last unit may go on in the next batch; its size is bounded
        last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        held = tuple(x[last:] for x in now)
        if last:
            yield from links(*(x[:last] for x in now))
    if held is not None and len(held[0]):
        yield from links(*held)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to connect all pairs within ``MAX_BITS`` bits."""
    cells = materialize(map_arrow(distinct.select("fp"), _cells, "cell bigint, fp bigint, resident boolean"), "cells")
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    crowded = crowded.select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("blocks"))
    rows = cells.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("cell", "fp", "resident", "block", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = rows.select(F.xxhash64("cell", low, high).alias("unit"), "fp", "resident")
    # units with one hash are worked on together, which adds no wrong link
    return map_arrow(units.repartition("unit").sortWithinPartitions("unit"), _meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fp and component_id (smallest doc_id that is reachable) of every row."""
    rows = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(fingerprint_links(distinct))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(named.join(names, "root").select("fp", "component_id", "root"), "components")
    return rows.join(of, "fp").select("doc_id", "row_key", "fp", "component_id", "root")


def fingerprint_text() -> Column:
    return F.lpad(F.lower(F.hex("fp")), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component: the smallest doc_id stays, of its rows one."""
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    kept = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("_doc_id"), F.col("first.row_key").alias("_key")
    )
    rows, restore = set_aside(docs, "doc_id", "text")
    keyed = rows.withColumn("_row_key", text_key())
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_doc_id")) & (F.col("_row_key") == F.col("_key"))
    stays = keyed.join(kept, same, "left_semi")
    # repeated rows
    once = Window.partitionBy("doc_id", "_row_key").orderBy("doc_id")
    return restore(stays.withColumn("_n", F.row_number().over(once)).where("_n = 1"))
