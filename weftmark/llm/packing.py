"""Best-fit-decreasing packing of token sequences.

Documents of one length are interchangeable, and so are open sequences with the same room left. So best fit decreasing
needs no list of documents: it runs over the number of pieces of each length (``capacity`` numbers, whatever the size of
the corpus), with a segment tree over the rooms 0 .. capacity that finds the tightest open sequence in logarithmic time.
Its output, runs of pieces of one length that go to consecutive sequences, says for the i-th piece of a length where it
lies; the numbering of pieces and the lookup are distributed. The result is that of best fit decreasing over all pieces
at once, piece after piece.

A text of any length is encoded whole and cut into pieces of ``capacity``; one longer than a slice is encoded alone.
Null and empty texts have the end id alone and are packed as pieces of one id. Repeated rows are packed each. Extra
columns of the input, whatever their names, are not read. An empty input gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.batches import documents, map_arrow, slices, slots, text_key
from weftmark.llm.tokenizing import TEXT_BYTES, crc_of, encoder
from weftmark.session import materialize

CAPACITY = 1024
# pieces that are numbered together in one window
ROWS_EACH = 200_000


class RoomTree:
    """Segment tree over rooms 0 .. capacity; a leaf holds the number of open sequences with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = np.zeros(2 * self.size, np.int64)

    def add(self, room: int, number: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += number
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that an open sequence has."""
        at = length + self.size
        while not self.count[at]:
            while at & 1:  # up from right children
                at //= 2
                if not at:
                    return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf
                return None
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over ``counts`` pieces of each length.

    Gives runs (length, first, sequence, offset, each): piece ``first + i`` of that length goes to sequence
    ``sequence + i // each`` at ``offset + (i % each) * length``, up to the next run of the length.
    """
    tree = RoomTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number of sequences)
    runs, used = [], 0

    def put(room: int, first: int, number: int) -> None:
        if room:
            open_.setdefault(room, []).append((first, number))
            tree.add(room, number)

    for length in sorted(counts, reverse=True):
        placed, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, number = capacity, used, -(-left // (capacity // length))
                used += number
            else:
                first, number = open_[room].pop()
                tree.add(room, -number)
            # the sequence that just took a piece is the tightest again, until no further one fits
            each = room // length
            full = min(number, left // each)
            if full:
                runs.append((length, placed, first, capacity - room, each))
                put(room - each * length, first, full)
                placed, left = placed + full * each, left - full * each
                first, number = first + full, number - full
            if number and left and left < each:
                runs.append((length, placed, first, capacity - room, each))
                put(room - left * length, first, 1)
                placed, left = placed + left, 0
                first, number = first + 1, number - 1
            if number:
                put(room, first, number)
    return runs


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, counts = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            rows, at = [], 0
            for i, n in enumerate(counts.tolist()):
                # a longer document's remainder comes first
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, k, a, b - a, crc_of(ids[at + a : at + b])))
                at += n
            of, *columns = (np.array(c, np.int64) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), batch.column("row_key").take(pa.array(of)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])],
                names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"],
            )

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, row_key, piece, start, length, ids_crc32."""
    rows = documents(docs).select("doc_id", text_key().alias("row_key"), "text")
    schema = "doc_id bigint, row_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_arrow(rows, _pieces(tokenizer, capacity), schema)


def _place(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    length, first, sequence, offset, each = table.T
    stride = int(first.max(initial=0)) + 1
    keys = length.astype(object) * stride + first if stride > 1 << 40 else length * stride + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            # the last run of the length that begins at or before the rank
            wanted = size.astype(keys.dtype) * stride + np.minimum(rank, stride - 1)
            at = np.searchsorted(keys, wanted, side="right") - 1
            k = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + k // each[at]), pa.array(offset[at] + k % each[at] * size)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the pieces.

    Pieces are numbered within their length: a hash of the row deals them to slots of about ``ROWS_EACH`` rows, a window
    numbers each (length, slot), and the counts of the slots before give the first number. The counts are one row for
    each length and slot.
    """
    pieces = materialize(pieces, "pieces")
    number = slots(pieces, ROWS_EACH)
    dealt = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.lit(number)))
    cells = materialize(dealt.groupBy("length", "slot").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "slot").orderBy("doc_id", "row_key", "piece")
    ranked = dealt.withColumn("at", F.row_number().over(inside)).join(firsts, ["length", "slot"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at") - 1).cast("bigint").alias("rank")
    )
    schema = (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
    return map_arrow(ranked, _place(best_fit_runs(counts, capacity)), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(cut_pieces(docs, tokenizer, capacity), capacity)
