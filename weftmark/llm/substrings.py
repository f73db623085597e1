"""Substring duplicates by relative Lempel-Ziv parsing.

A window is ``WINDOW_WORDS`` consecutive words. Every document is factored against indexed reference blocks: from where the last
factor ended, a factor follows that place of the reference, among all places of its first window, along which the text goes on
longest; it stops at the end of either document. A factor of one window or more is a duplicate span: all words of its windows. The
windows that lie over the border of two factors are windows of the parse themselves, so a repeat over a border is tested there.

The corpus is too large to hold every document against every block, so the blocks are made by content. Windows are
dealt by their minimizer, the smallest hash of the ``GRAM_WORDS``-word runs inside: equal windows have equal minimizers,
so all places that a window can refer to are in one block. Consecutive windows with one minimizer stay together as a
segment. A factor thus ends where its segment ends; the windows over that boundary begin in the next segment and are
factored there, and the spans of neighbouring factors overlap and are merged.

First, the minimizers of all segments are counted, without windows. Only segments whose minimizer another segment shares can repeat
elsewhere, so only their windows are moved.

Then each task factors its own documents against themselves, a bounded slice at a time. What repeats there is settled
on the spot, and only the first place of every window is sent on. So a passage that a third of all documents share
reaches its block once per slice, not once per document, and the block keeps one place of each of its windows.

The windows over the borders of such a passage all differ and share its minimizer. A task that meets more than half of
``BLOCK_WINDOWS`` different windows of one minimizer passes the windows of that minimizer on, each as a row of its own,
and these are dealt anew by window: equal ones still meet, and no task holds more than a bounded part of them.

A text is read whole; one longer than a slice is a slice of its own, of about 60 bytes for each word and 16 for each repeated window.
Words are runs of other characters than blank, tab, line feed, vertical tab, form feed and carriage return. Window hashes
have 64 bits and are compared only under equal minimizer hashes of another 64. A null or empty text has no words. Repeated
rows are copies of each other. A null doc_id is kept as null. Extra columns are not read. An empty input gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.functions.bitmaps import rows_in_map
from weftmark.llm.batches import byte_texts, documents, map_arrow, slices, text_key
from weftmark.session import materialize

WINDOW_WORDS = 35
GRAM_WORDS = 12
# words hashed once and remembered by a task
MEMO_WORDS = 500_000
# windows that a block holds at a time
BLOCK_WINDOWS = 1 << 20
# bits of the map of shared minimizers for each of them
MAP_BITS = 8
# rows of passed windows that go out at a time
PASSED_ROWS = 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_NONE = np.uint64(0)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word, 8)
        return value


def mix_bits(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole number (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every ``length`` consecutive words, by doubling."""
    out, done, rest = None, 0, length
    power, have = words, 1  # hashes of ``have`` words
    while True:
        if rest & 1:
            if out is None:
                out, done = power, have
            else:
                shift = np.uint64(pow(_BASE, done, 1 << 64))
                n = len(words) - done - have + 1
                out, done = out[:n] + power[done : done + n] * shift, done + have
        rest >>= 1
        if not rest:
            return mix_bits(out)
        n = len(words) - 2 * have + 1
        power = power[:n] + power[have : have + n] * np.uint64(pow(_BASE, have, 1 << 64))
        have *= 2


def run_minima(x: np.ndarray, length: int) -> np.ndarray:
    """Smallest of every ``length`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= length:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    over = length - have
    return np.minimum(x[: len(x) - over], x[over:]) if over else x


def longest_places(kinds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place, its neighbours in the order of what follows up to ``ends``; one of them has the longest common part.

    The order comes by doubling: ranks of the next 1, 2, 4, ... windows.
    """
    n = len(kinds)
    place = np.arange(n)
    _, rank = np.unique(kinds, return_inverse=True)
    length, most = 1, int((ends - place).max())
    while length < most and rank.max() < n - 1:
        after = place + length
        following = np.where(after < ends, rank[np.minimum(after, n - 1)] + 1, 0)
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + following, return_inverse=True)
        length *= 2
    order = np.argsort(rank, kind="stable")
    before, behind = np.full(n, -1), np.full(n, -1)
    before[order[1:]], behind[order[:-1]] = order[:-1], order[1:]
    return before, behind


def parse(kinds: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Greedy factors: first window and place of each. Every kind occurs twice at least; ``ends`` bounds the factors."""
    starts, places = [], []
    before, behind = longest_places(kinds, ends)
    at = 0
    while at < len(kinds):
        best, place = 0, at
        for other in (before[at], behind[at]):
            if other >= 0:
                most = int(min(ends[at] - at, ends[other] - other))
                differs = kinds[at : at + most] != kinds[other : other + most]
                same = int(differs.argmax()) if differs.any() else most
                if same > best:
                    best, place = same, int(other)
        starts.append(at)
        places.append(place)
        at += best
    return starts, places


def factors(windows: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factor the windows of a block against the block.

    ``breaks`` marks the first window of each segment. Gives the first place of each window's kind, whether it has an equal, and
    the first window of each factor or of each run without one.
    """
    _, first, of, counts = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
    repeated = counts[of] > 1
    begins = breaks.copy()
    if len(windows):
        begins[0] = True
    begins[1:] |= repeated[1:] != repeated[:-1]
    at = np.flatnonzero(repeated)
    if len(at):
        # runs of windows with an equal, inside segments
        edges = np.append(np.flatnonzero(begins[at]), len(at))
        ends = np.repeat(edges[1:], np.diff(edges))
        begins[at[parse(of[at], ends)[0]]] = True
    return first[of], repeated, begins


def _spans(doc: np.ndarray, start: np.ndarray, marked: np.ndarray, begins: np.ndarray, window: int):
    """Factors of marked windows as (doc, first word, end word)."""
    at = np.flatnonzero(begins)
    lengths = np.diff(np.append(at, len(marked)))
    keep = marked[at]
    at, lengths = at[keep], lengths[keep]
    return doc[at], start[at], start[at] + lengths + window - 1


_ROWS = pa.schema([
    ("minimizer", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
    ("windows", pa.binary()), ("settled", pa.binary()),
])
_ROWS_DDL = "minimizer bigint, doc_id bigint, row_key bigint, start bigint, end bigint, windows binary, settled binary"


def _slice_windows(batches: Iterator[pa.RecordBatch], window: int, gram: int, whole: bool = True):
    """Of every slice: batch, and document, first word, hash (if ``whole``), minimizer and break of each window."""
    known = _WordHashes()
    for batch in slices(batches):
        if len(known) > MEMO_WORDS:
            known = _WordHashes()
        lists = [t.split() for t in byte_texts(batch)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        words = np.fromiter((known[w] for ws in lists for w in ws), np.uint64, int(counts.sum()))
        del lists
        if len(words) < window:
            continue
        owner = np.repeat(np.arange(len(counts)), counts)
        minima = run_minima(run_hashes(words, gram), window - gram + 1)
        inside = np.flatnonzero(owner[: len(minima)] == owner[window - 1 :])
        if not len(inside):
            continue
        doc, minima = owner[inside], minima[inside]
        start = inside - (np.cumsum(counts) - counts)[doc]
        breaks = np.ones(len(inside), bool)
        breaks[1:] = (doc[1:] != doc[:-1]) | (minima[1:] != minima[:-1])
        yield batch, doc, start, run_hashes(words, window)[inside] if whole else None, minima, breaks


def _segment_minimizers(window: int, gram: int):
    """The minimizer of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, minima, breaks in _slice_windows(batches, window, gram, whole=False):
            yield pa.RecordBatch.from_arrays([pa.array(minima[breaks].view(np.int64))], names=["minimizer"])

    return run


def _own_factors(window: int, gram: int):
    """Spans that repeat within a slice, and segments of first places for the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc, start, hashes, minima, breaks in _slice_windows(batches, window, gram):
            refers, repeated, begins = factors(hashes, breaks)
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            of, lo, hi = _spans(doc, start, repeated, begins, window)
            none = pa.nulls(len(of), pa.binary())
            of = pa.array(of)
            # spread over the tasks that only pass them on
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix_bits(lo.astype(np.uint64)).view(np.int64)), ids.take(of), keys.take(of), pa.array(lo), pa.array(hi), none, none], schema=_ROWS
            )
            # segments: first places only, other windows blank, none without a first place
            own = refers == np.arange(len(refers))
            hashes = np.where(own, hashes, _NONE)
            at = np.flatnonzero(breaks)
            ends = np.append(at[1:], len(hashes))
            some = np.add.reduceat(own, at) > 0
            at, ends = at[some], ends[some]
            data, flags = hashes.astype("<u8").tobytes(), repeated.astype(np.uint8).tobytes()
            of = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(minima[at].view(np.int64)), ids.take(of), keys.take(of), pa.array(start[at]), pa.array(start[at] + (ends - at)),
                    pa.array([data[8 * a : 8 * b] for a, b in zip(at.tolist(), ends.tolist())], pa.binary()),
                    pa.array([flags[a:b] for a, b in zip(at.tolist(), ends.tolist())], pa.binary()),
                ],
                schema=_ROWS,
            )

    return run


def _block_factors(window: int, pass_on: bool = False):
    """Spans of segments that repeat in other segments of their block; settled spans pass through.

    With ``pass_on`` the output has the columns of the input, and the windows of a minimizer with too many different ones
    are among its rows, one window in each, under a new minimizer made of the old one and the window.
    """

    names = ["doc_id", "row_key", "start", "end"]

    def unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
        """Windows and settled marks of all segments, joined, the segment and place of each, and where segments begin."""
        data = np.frombuffer(b"".join(table.column("windows").to_pylist()), "<u8").astype(np.uint64)
        settled = np.frombuffer(b"".join(table.column("settled").to_pylist()), np.uint8).astype(bool)
        start = table.column("start").to_numpy()
        sizes = table.column("end").to_numpy() - start
        row = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        return data, settled, row, start[row] + np.arange(len(data)) - begin[row], begin, sizes

    def spans_out(spans: pa.RecordBatch) -> pa.RecordBatch:
        if not pass_on:
            return spans
        none = pa.nulls(spans.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([pa.nulls(spans.num_rows, pa.int64()), *spans.columns, none, none], schema=_ROWS)

    def single_windows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, settled, row, starts, _, _ = unpack(table)
        real = np.flatnonzero(data != _NONE)
        data, of, starts = data[real], pa.array(row[real]), starts[real]
        old = table.column("minimizer").to_numpy().view(np.uint64)[row[real]]

        def cells(values: np.ndarray) -> pa.Array:
            ends = np.arange(len(values) + 1, dtype=np.int32) * values.itemsize
            return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])

        out = pa.table(
            [
                pa.array(mix_bits(old ^ mix_bits(data)).view(np.int64)), *(table.column(c).combine_chunks().take(of) for c in names[:2]),
                pa.array(starts), pa.array(starts + 1), cells(data.astype("<u8")), cells(settled[real].astype(np.uint8)),
            ],
            schema=_ROWS,
        )
        yield from out.to_batches(max_chunksize=PASSED_ROWS)

    def settle(table: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
        """New spans of the block, and the block less all but the first place of each window, marked as settled."""
        data, settled, row, starts, begin, sizes = unpack(table)
        breaks = np.zeros(len(data), bool)
        breaks[begin] = True
        real = np.flatnonzero(data != _NONE)
        # blank windows part the segments around them
        breaks = breaks[real]
        breaks[1:] |= np.diff(real) > 1
        refers, repeated, begins = factors(data[real], breaks)
        news = repeated & ~settled[real]
        if len(news):
            begins[1:] |= news[1:] != news[:-1]
        of, lo, hi = _spans(row[real], starts[real], news, begins, window)
        of = pa.array(of)
        columns = [table.column(c).combine_chunks().take(of) for c in names[:2]]
        spans = pa.RecordBatch.from_arrays([*columns, pa.array(lo), pa.array(hi)], names=names)

        kept = np.zeros(len(data), bool)
        kept[real[refers == np.arange(len(refers))]] = True
        settled[real] |= repeated
        some = np.flatnonzero(np.add.reduceat(kept, begin) > 0) if len(begin) else begin
        left, flags = np.where(kept, data, _NONE).astype("<u8").tobytes(), settled.astype(np.uint8).tobytes()
        cut = [(int(begin[i]), int(begin[i] + sizes[i])) for i in some]
        rest = table.take(pa.array(some)).select(["minimizer", *names])
        rest = rest.append_column("windows", pa.array([left[8 * x : 8 * y] for x, y in cut], pa.binary()))
        return spans, rest.append_column("settled", pa.array([flags[x:y] for x, y in cut], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, limit = 0, BLOCK_WINDOWS
        large = None  # the minimizer whose windows are passed on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            passed = table.filter(table.column("windows").is_null()).select(names)
            yield from map(spans_out, passed.to_batches())
            table = table.filter(table.column("windows").is_valid())
            if large is not None:
                same = pc.equal(table.column("minimizer"), large)
                yield from single_windows(table.filter(same))
                table = table.filter(pc.invert(same))
            if not table.num_rows:
                continue
            held.append(table.select(["minimizer", *names, "windows", "settled"]))
            size += _windows(table)
            if size >= limit:
                # rows of the last minimizer wait for the rest of theirs; a large group keeps its distinct windows
                table = pa.concat_tables(held)
                minimizer = table.column("minimizer").to_numpy()
                last = int(np.searchsorted(minimizer, minimizer[-1]))
                if last:
                    yield spans_out(settle(table.slice(0, last))[0])
                    table = table.slice(last)
                else:
                    spans, table = settle(table)
                    yield spans_out(spans)
                    if pass_on and _windows(table) > BLOCK_WINDOWS // 2:
                        large = int(minimizer[-1])
                        yield from single_windows(table)
                        table = table.slice(0, 0)
                held, size = [table], _windows(table)
                limit = max(BLOCK_WINDOWS, 2 * size)
        if held:
            yield spans_out(settle(pa.concat_tables(held))[0])

    return run


def _windows(table: pa.Table) -> int:
    return int(pc.sum(pc.binary_length(table.column("windows"))).as_py() or 0) // 8


def duplicate_spans(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """doc_id, row_key, start and end (words, end exclusive) of factors; they may overlap."""
    rows = documents(docs).select("doc_id", text_key().alias("row_key"), "text")
    minimizers = map_arrow(rows.select("text"), _segment_minimizers(window, gram), "minimizer bigint")
    shared = minimizers.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer")
    shared = materialize(shared, "shared-minimizers")
    own = map_arrow(rows, _own_factors(window, gram), _ROWS_DDL)
    own = rows_in_map(own, F.col("minimizer"), shared, "minimizer", MAP_BITS, always=F.col("windows").isNull())
    blocks = own.repartition("minimizer").sortWithinPartitions("minimizer")
    found = materialize(map_arrow(blocks, _block_factors(window, pass_on=True), _ROWS_DDL), "spans")
    # windows of minimizers with too many of them meet again, dealt by window
    large = found.where("windows IS NOT NULL").repartition("minimizer").sortWithinPartitions("minimizer")
    spans = map_arrow(large, _block_factors(window), "doc_id bigint, row_key bigint, start bigint, end bigint")
    return found.where("windows IS NULL").select(*spans.columns).unionByName(spans)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, spans in zip(byte_texts(batch), batch.column("spans").to_pylist()):
            words = text.split()
            total = len(words)
            if spans:
                keep = np.zeros(total + 1, np.int64)
                np.add.at(keep, [s["start"] for s in spans], 1)
                np.add.at(keep, [s["end"] for s in spans], -1)
                words = [w for w, covered in zip(words, np.cumsum(keep).tolist()) if not covered]
            out.append((total, total - len(words), b" ".join(words)))
        totals, removed, texts = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "row_key", "n_words", "n_removed", "kept"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cut in _cut(batches):
        kept = [hashlib.sha256(t).hexdigest() for t in byte_texts(cut, "kept")]
        yield pa.RecordBatch.from_arrays(
            [cut.column("doc_id"), cut.column("n_words"), cut.column("n_removed"), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _with_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    spans = duplicate_spans(docs, window, gram)
    grouped = spans.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")).select(
        F.col("doc_id").alias("of_doc"), F.col("row_key").alias("of_key"), "spans"
    )
    rows = documents(docs).select("doc_id", text_key().alias("row_key"), "text")
    same = rows.doc_id.eqNullSafe(F.col("of_doc")) & (rows.row_key == F.col("of_key"))
    return rows.join(grouped, same, "left").select("doc_id", "row_key", "text", "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """doc_id, row_key, n_words, n_removed and the kept words of every document, joined by blanks."""
    schema = "doc_id bigint, row_key bigint, n_words bigint, n_removed bigint, kept string"
    return map_arrow(_with_spans(docs, window, gram), _cut, schema)


def repeat_digests(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return map_arrow(_with_spans(docs, window, gram), _digest, schema)
