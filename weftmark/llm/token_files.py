"""Token ids in files: fixed-width bit packing with block offsets.

A token table is a folder with two Parquet tables. ``segments`` has one row per run of whole documents: the ids of all its
documents, each in ``width`` bits (the fewest that hold every id of the vocabulary, lowest bit first), in blocks of
``BLOCK_TOKENS`` ids; ``block_offsets`` are the byte positions of the blocks in ``payload``, so that a reader can fetch and
unpack single blocks with numpy. Segments and the documents in them are in ascending order of doc_id (null first);
``shard`` and ``segment`` number them. ``shards`` has the place of each shard's first id among all ids.

A text of any length is encoded whole; one longer than a slice is encoded alone, and its ids are one segment, however many.
Null and empty texts have the end id alone. Rows with the same doc_id are kept, ordered by text. Extra columns of the
input, whatever their names, are not read. An empty input gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmark.llm.batches import documents, map_arrow, slices
from weftmark.llm.tokenizing import TEXT_BYTES, crc_of, encoder

# ids in a block, a multiple of 8 so that blocks begin at whole bytes; ids after which a segment ends with its document
BLOCK_TOKENS = 1024
SEGMENT_TOKENS = 1 << 16

_SEGMENTS = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
    ("min_doc", pa.int64()), ("max_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("width", pa.int32()), ("block_offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])
_SEGMENTS_DDL = (
    "shard int, segment int, first_token bigint, n_tokens bigint, min_doc bigint, max_doc bigint, "
    "doc_ids array<bigint>, lengths array<bigint>, width int, block_offsets array<bigint>, payload binary"
)


def id_width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The ids in ``width`` bits each, lowest bit first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    if width == 32:
        return ids.astype("<u4").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed data."""
    if width in (16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * width].reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def unpack_range(data: bytes, offsets: np.ndarray, width: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` .. ``start + count - 1`` of a segment; only the blocks that hold them are unpacked."""
    if not count:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK_TOKENS, (start + count - 1) // BLOCK_TOKENS
    end = offsets[last + 1] if last + 1 < len(offsets) else len(data)
    held = (start + count) - first * BLOCK_TOKENS
    return unpack(data[offsets[first] : end], width, held)[start - first * BLOCK_TOKENS :]


def _segment(shard: int, number: int, first: int, docs: list, lengths: list, ids: np.ndarray, width: int) -> dict:
    known = [d for d in docs if d is not None]
    return {
        "shard": shard, "segment": number, "first_token": first, "n_tokens": len(ids),
        "min_doc": min(known, default=None), "max_doc": max(known, default=None), "doc_ids": docs, "lengths": lengths,
        "width": width, "block_offsets": list(range(0, -(-len(ids) // 8) * width, BLOCK_TOKENS // 8 * width)),
        "payload": pack(ids, width),
    }


def _encode_partition(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard = encoder(path), TaskContext.get().partitionId()
        width = id_width(coder.vocabulary)
        docs, lengths, parts, held, number, first = [], [], [], 0, 0, 0
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, counts = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            at, rows = 0, []
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                docs.append(doc)
                lengths.append(n)
                parts.append(ids[at : at + n])
                at, held = at + n, held + n
                if held >= SEGMENT_TOKENS:
                    rows.append(_segment(shard, number, first, docs, lengths, np.concatenate(parts), width))
                    docs, lengths, parts, held, number, first = [], [], [], 0, number + 1, first + held
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SEGMENTS)
        if docs:
            row = _segment(shard, number, first, docs, lengths, np.concatenate(parts), width)
            yield pa.RecordBatch.from_pylist([row], _SEGMENTS)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode every text and write the token table to the folder ``path``.

    One shuffle by ranges of doc_id brings the documents in order; each task then encodes its range and closes a
    segment at the first document end after ``SEGMENT_TOKENS`` ids.
    """
    ordered = (
        documents(docs)
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    encoded = map_arrow(ordered, _encode_partition(tokenizer), _SEGMENTS_DDL)
    encoded.write.mode("overwrite").parquet(f"{path}/segments")
    # one row for each shard goes through this window
    sizes = docs.sparkSession.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint"))).write.mode(
        "overwrite"
    ).parquet(f"{path}/shards")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.parquet(f"{path}/shards").select("shard", "start")
    return spark.read.parquet(f"{path}/segments").join(shards, "shard").withColumn(
        "first_token", F.col("start") + F.col("first_token")
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["width"], row["n_tokens"])
            lengths = np.array(row["lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            crcs = [crc_of(ids[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first_token"]), pa.array(lengths), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Place, number and checksum of every document's ids, from the files."""
    rows = _segments(spark, path).select("first_token", "n_tokens", "doc_ids", "lengths", "width", "payload")
    return map_arrow(rows, _digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start and ids of the asked documents (all if none are named).

    The ranges of doc_id are pushed down to the files, and only the blocks with the asked documents are unpacked.
    """
    rows = _segments(spark, path)
    if doc_ids is not None:
        if not doc_ids:
            rows = rows.where(F.lit(False))
        rows = rows.where((F.col("max_doc") >= min(doc_ids, default=0)) & (F.col("min_doc") <= max(doc_ids, default=0)))
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, out = 0, []
                for doc, n in zip(row["doc_ids"], row["lengths"]):
                    if wanted is None or doc in wanted:
                        ids = unpack_range(row["payload"], row["block_offsets"], row["width"], at, n)
                        out.append((doc, row["first_token"] + at, ids.tolist()))
                    at += n
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                        names=["doc_id", "start", "ids"],
                    )

    columns = ("first_token", "doc_ids", "lengths", "width", "block_offsets", "payload")
    return map_arrow(rows.select(*columns), read, "doc_id bigint, start bigint, ids array<int>")
