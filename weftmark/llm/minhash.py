"""MinHash near-duplicates by fast similarity sketches.

The set of a document is its distinct shingles of ``SHINGLE_WORDS`` words. Its sketch has ``BINS`` bins that are filled in
rounds: in each of the first ``BINS`` rounds every shingle is thrown into one bin by a hash of the round, in each of the next
``BINS`` rounds all shingles go to one bin, the same for all sets. A bin keeps the smallest hash of the first round that reaches
it, and rounds end when no bin is empty, so every bin fills, with about ``BINS * ln(BINS)`` throws for a small set and one
round for a large one. Two sets agree in a bin with probability of their similarity, and the share of bins in which they
agree is concentrated around it as if bins were independent.

Equal sets are merged first. Of the others, those that agree in all bins of one of the bands meet in its bucket; a bucket gives
a spanning forest of the pairs whose sketches, two bits a bin, differ in ``MISMATCHES`` bins at most. The components of these
candidate links are groups, in which links are confirmed on the full sets: a group is worked on at once, or in pairs of
blocks of about ``BLOCK_SHINGLES`` shingles. So neither a bucket nor a group gives all its pairs, and a set is sent to one task, or, in
a large group, to as many as there are blocks; confirming grows with the square of the largest group's blocks.

Two sets of the least similarity miss all bands with probability (1 - 0.85**6)**42 < 3e-9 and exceed the mismatches with one of
about the same size; nothing else loses a link. No bucket, group or number of partners is capped. Fewer than ``LEAST_SHINGLES``
shingles give a link between equal sets only, so such sets need no sketch.

Shingles are compared by 64-bit hashes, whole sets by 128 bits. Words are runs of other characters than blank, tab, line feed,
vertical tab, form feed and carriage return; A-Z are lower-cased. A text with fewer words than a shingle is one shingle as
a whole; one without words (null, empty) has an empty set and is linked with nothing. Texts of any length are read whole, and
a long one is worked on alone. Rows with a null doc_id take part, but never name a component unless all its rows have none.
Repeated rows are copies. Extra columns are not read. An empty input gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.functions.bitmaps import rows_in_map
from weftmark.llm.batches import byte_texts, documents, map_arrow, slices, text_key
from weftmark.llm.components import components
from weftmark.llm.simhash import shingle_hashes
from weftmark.session import materialize

SHINGLE_WORDS = 5
# links have 100 * intersection >= PERCENT * union
PERCENT = 85
# sets with fewer shingles cannot have that with another set than an equal one
LEAST_SHINGLES = 6
BINS = 256
BANDS = 42
BAND_BINS = 6
MISMATCHES = 64
# sets of a bucket that one task compares
BUCKET_ROWS = 4096
# shingles of a group that one task holds, about; one set at least
BLOCK_SHINGLES = 1 << 20
# bytes of text hashed at a time
TEXT_BYTES = 2 << 20

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIRS = np.uint64(0x5555555555555555)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of 64-bit numbers, another function for each salt."""
    x = x ^ np.uint64((salt + 1) * int(_ODD) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def sketches(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of ``BINS`` hashes for each set; ``counts`` has the sizes of the sets, one at least, that ``shingles`` joins."""
    out = np.full(len(counts) * BINS, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    empty = np.full(len(counts), BINS)
    for turn in range(2 * BINS):
        if not len(owner):
            break
        value = mixed(shingles, turn)
        # a hash that looks like an empty bin is made another one
        value[value == _EMPTY] -= np.uint64(1)
        # the bin takes other bits than those that tell the smallest hash first
        place = (value & np.uint64(BINS - 1)).astype(np.int64) if turn < BINS else turn - BINS
        cell = owner * BINS + place
        free = out[cell] == _EMPTY
        cell, value = cell[free], value[free]
        np.minimum.at(out, cell, value)
        filled = np.bincount(np.unique(cell) // BINS, minlength=len(counts))
        empty -= filled
        if (filled[empty == 0] > 0).any():
            goes_on = empty[owner] > 0
            owner, shingles = owner[goes_on], shingles[goes_on]
    return out.reshape(-1, BINS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One key for each set and band."""
    bins = sketch[:, : BANDS * BAND_BINS].reshape(-1, BANDS, BAND_BINS)
    key = np.broadcast_to(mixed(np.arange(BANDS, dtype=np.uint64), 7), bins.shape[:2])
    for k in range(BAND_BINS):
        key = mixed(key + bins[:, :, k], k)
    return key.view(np.int64)


def two_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of every bin, 32 bins in a number."""
    # bits that neither choose the bin nor matter much for the smallest hash
    bits = (sketch >> np.uint64(20) & np.uint64(3)).reshape(len(sketch), BINS // 32, 32)
    return np.bitwise_or.reduce(bits << (2 * np.arange(32, dtype=np.uint64)), axis=2)


def mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bins two-bit sketches differ."""
    apart = a ^ b
    return np.bitwise_count((apart | apart >> np.uint64(1)) & _PAIRS).sum(axis=-1)


def distinct_shingles(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE_WORDS), np.uint64))


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in slices(batches, limit=TEXT_BYTES):
        sets = [distinct_shingles(t) for t in byte_texts(batch)]
        counts = np.array([len(s) for s in sets], np.int64)
        keys = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
        high, low = ([None if k is None else (k >> shift & (1 << 64) - 1) - (1 << 63) for k in keys] for shift in (64, 0))
        large = np.flatnonzero(counts >= LEAST_SHINGLES)
        bands: list[bytes | None] = [None] * len(sets)
        bits = list(bands)
        if len(large):
            sketch = sketches(np.concatenate([sets[i] for i in large]), counts[large])
            for i, key, two in zip(large.tolist(), band_keys(sketch), two_bits(sketch)):
                bands[i], bits[i] = key, two.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("row_key"), pa.array(counts), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
            ],
            names=["doc_id", "row_key", "n", "high", "low", "bands", "bits"],
        )


_ROWS = "doc_id bigint, row_key bigint, n bigint, high bigint, low bigint, bands array<bigint>, bits binary"


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units; the rows of a unit follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        cuts = np.flatnonzero(np.diff(unit)) + 1
        # the last unit may go on in the next batch
        last = int(cuts[-1]) if len(cuts) else 0
        if held and len(unit) and held[-1].column("unit")[-1].as_py() != unit[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        if batch.num_rows > last:
            held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    return begins, np.append(begins[1:], len(unit))


def near_forest(bits: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what pairs with few mismatches connect; one less than sets at most."""
    a, b = [], []
    left = np.arange(len(bits))
    reached: list[int] = []
    while len(left):
        if not reached:
            reached, left = [int(left[-1])], left[:-1]
        at = reached.pop()
        near = mismatches(bits[left], bits[at]) <= MISMATCHES
        if near.any():
            found = left[near].tolist()
            left = left[~near]
            a += [at] * len(found)
            b += found
            reached += found
    return a, b


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of buckets."""
    for table in _by_unit(batches):
        unit, ids = table.column("unit").to_numpy(), table.column("id").to_numpy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        begins, ends = _bounds(unit)
        # buckets of two at once
        two = begins[ends - begins == 2]
        two = two[mismatches(bits[two], bits[two + 1]) <= MISMATCHES]
        a, b = [two], [two + 1]
        for lo, hi in zip(begins.tolist(), ends.tolist()):
            if hi - lo > 2:
                x, y = near_forest(bits[lo:hi])
                a.append(np.array(x, np.int64) + lo)
                b.append(np.array(y, np.int64) + lo)
        yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(a)]), pa.array(ids[np.concatenate(b)])], names=["a", "b"])


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Rows in ``blocks`` blocks of their group, once for each other block; a pair of blocks is a unit."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    # units with one hash are worked on together, which adds no wrong link
    return rows.withColumn("unit", F.xxhash64(group, low, high)).drop("block", "other", "blocks", group)


def candidate_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of sets whose sketches are near, enough to connect all near pairs that share a bucket."""
    keyed = distinct.where(F.col("bands").isNotNull()).select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select("key", F.ceil(F.col("n") / BUCKET_ROWS).alias("blocks"))
    members = materialize(keyed.join(shared, "key"), "buckets")
    units = _block_pairs(members, "key").join(distinct.select("id", "bits"), "id").select("unit", "id", "bits")
    return map_arrow(units.repartition("unit").sortWithinPartitions("unit"), _meet, "a bigint, b bigint")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text, once for each task."""
    seen: set[int] = set()
    for batch in slices(batches, limit=TEXT_BYTES):
        ids = batch.column("id").to_pylist()
        new = []
        for i, number in enumerate(ids):
            if number not in seen:
                seen.add(number)
                new.append(i)
        if new:
            batch = batch.take(pa.array(new))
            sets = [distinct_shingles(t).tobytes() for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])


def similar_forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that connect what pairs of similar sets connect; every one is confirmed on the whole sets."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(int(codes.max()) + 1, np.int8)
    left, of, begin, size = np.arange(len(sets)), codes, starts, sizes
    a, b = [], []
    reached: list[int] = []
    while len(left):
        if not reached:
            reached.append(int(left[-1]))
            left, of, begin, size = left[:-1], of[: begin[-1]], begin[:-1], size[:-1]
            if not len(left):
                break
        at = reached.pop()
        own = codes[starts[at] : starts[at] + sizes[at]]
        marked[own] = 1
        both = np.add.reduceat(marked[of], begin, dtype=np.int64)
        marked[own] = 0
        near = 100 * both >= PERCENT * (sizes[at] + size - both)
        if near.any():
            found = left[near].tolist()
            a += [at] * len(found)
            b += found
            reached += found
            left, of, size = left[~near], of[np.repeat(~near, size)], size[~near]
            begin = np.cumsum(size) - size
    return a, b


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _by_unit(batches):
        unit, ids = table.column("unit").to_numpy(), table.column("id").to_numpy()
        begins, ends = _bounds(unit)
        a, b = [], []
        for lo, hi in zip(begins.tolist(), ends.tolist()):
            if hi - lo > 1:
                # a set may come from several tasks
                _, once = np.unique(ids[lo:hi], return_index=True)
                shingles = table.column("shingles").slice(lo, hi - lo).take(pa.array(once)).to_pylist()
                x, y = similar_forest([np.frombuffer(s, np.uint64) for s in shingles])
                a += ids[lo + once[x]].tolist() if x else []
                b += ids[lo + once[y]].tolist() if y else []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed_links(docs: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) between similar sets of one group (node, root), enough to connect all of them."""
    members = distinct.join(groups.select(F.col("node").alias("id"), F.col("root").alias("group")), "id")
    members = materialize(members.select("id", "group", "n", "source"), "groups")
    blocks = members.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    asked = members.select("id", F.col("source.doc_id").alias("of_doc"), F.col("source.row_key").alias("of_key"))
    rows = documents(docs).withColumn("row_key", text_key())
    # of the texts, few more than those of the groups are moved
    row = F.xxhash64("doc_id", "row_key")
    rows = rows_in_map(rows, row, members.select(F.xxhash64("source.doc_id", "source.row_key").alias("row")), "row")
    same = rows.doc_id.eqNullSafe(F.col("of_doc")) & (rows.row_key == F.col("of_key"))
    sets = map_arrow(rows.join(asked, same).select("id", "text"), _set_rows, "id bigint, shingles binary")
    units = _block_pairs(members.join(blocks, "group").select("id", "group", "blocks"), "group").join(sets, "id")
    return map_arrow(units.repartition("unit").sortWithinPartitions("unit"), _confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles and component_id (smallest doc_id that is reachable) of every row."""
    keyed = documents(docs).select("doc_id", text_key().alias("row_key"), "text")
    rows = materialize(map_arrow(keyed, _sketch_rows, _ROWS), "sketches")
    distinct = rows.where("n > 0").groupBy("high", "low").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "row_key")).alias("source"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("bits").alias("bits"),
    )
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "sets")
    groups = components(candidate_links(distinct))
    roots = components(confirmed_links(docs, distinct, groups))
    named = distinct.join(roots, distinct.id == roots.node, "left").select(
        "high", "low", "first", F.coalesce("root", "id").alias("root")
    )
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(named.join(names, "root").select("high", "low", "component_id"), "components")
    linked = rows.join(of, ["high", "low"]).select("doc_id", "row_key", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "row_key", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles")


def keep_first(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document names its component) of every row."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
