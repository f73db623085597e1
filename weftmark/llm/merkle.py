"""Merkle manifest of a dataset as a postorder append log.

Every document is a leaf; the leaves of a language, by doc_id, make a binary tree, and the roots of the languages, by language,
another one. Two consecutive nodes have the hash of their joined hex digests above them, a last single one the hash of its
own; a tree ends where one node is left.

The log of a tree holds its nodes in the order in which they are completed when leaves are appended one by one: each leaf, then
the nodes that it completes. The first i leaves complete ``2 * i - popcount(i)`` nodes, so a node that ends with leaf i
and stands ``level`` above the leaves has position ``2 * i - popcount(i) + level``. Positions thus follow from subtree
sizes alone. Builders are aligned: each takes ``2**BLOCK_LEVELS`` leaves, whose nodes up to that level fill consecutive
positions, whatever other builders do. The nodes above come from builders over block roots in the same manner, tier by tier.
To extract a proof, the positions of all siblings are computed from index and leaf count, and the log is read there: inside the
block of the leaf, and by a join on positions above it.

Files below the path: ``docs/blocks`` (one row for each builder, nodes packed in completion order), ``docs/upper`` (nodes above,
one row each), ``docs/roots`` (one row for each language), and ``top`` with the same three for the tree of languages. A task holds one
block. No file, task or join key holds a language as a whole.

Nulls in any column are part of the hash. Documents without a language are a tree of their own, the first; a null doc_id comes
before all others. Rows with one doc_id are ordered by their hash; repeated rows are leaves of their own. Texts are hashed whole, in the
JVM, at any length up to the 2 GB of a Spark string. Extra columns are not read. An empty table has no trees and no proofs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.functions.ordering import sequence_numbers
from weftmark.llm.batches import map_arrow, own_columns
from weftmark.session import materialize, workspace

BLOCK_LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# -- leaves --------------------------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(**replaced: Column) -> Column:
    """Hash of a document's fields, some of them replaced."""
    return F.sha2(F.concat(*(_field(replaced.get(name, F.col(name))) for name in FIELDS)), 256)


def leaves(docs: DataFrame, altered: Column | None = None, **replaced: Column) -> DataFrame:
    """tree, doc_id, leaf and claim of every document.

    The tree is the language, marked so that null sorts first. The claim is the hash of a row as it is presented later: with
    ``replaced`` fields where ``altered`` holds, else null, which stands for the leaf.
    """
    claim = F.when(altered, F.unhex(row_hash(**replaced))) if altered is not None else F.lit(None).cast("binary")
    return own_columns(docs, *FIELDS).select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(row_hash()).alias("leaf"),
        claim.alias("claim"),
    )


# -- positions -----------------------------------------------------------------------------------------------


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def position(leaves, level, index):
    """Place in the log of node ``index`` of ``level``; numbers or arrays."""
    last = np.minimum((np.int64(index) + 1) << np.int64(level), np.int64(leaves)) - 1
    return 2 * last - np.bitwise_count(last).astype(np.int64) + level


def sibling(leaves, level, index):
    """Number of the other node of a pair, -1 where there is none."""
    other = np.int64(index) ^ 1
    return np.where(other < -(-np.int64(leaves) >> np.int64(level)), other, -1)


def _hash(text: bytes) -> bytes:
    return sha256(text).hexdigest().encode()


def completed(nodes: list[bytes], levels: int) -> Iterator[tuple[int, int, bytes]]:
    """Append nodes; gives (level, index, hex digest) of every node, in completion order."""
    left: list[bytes] = [b""] * (levels + 1)
    for i, node in enumerate(nodes):
        last = i == len(nodes) - 1
        level = 0
        yield level, i, node
        while level < levels:
            if i >> level & 1:
                node = _hash(left[level] + node)
            elif last:
                node = _hash(node)
            else:
                left[level] = node
                break
            level += 1
            yield level, i >> level, node


# -- builders ------------------------------------------------------------------------------------------------

_BLOCKS = "tree string, block bigint, total bigint, root binary, nodes binary, keys array<bigint>, claims array<binary>"
_UPPER = "tree string, total bigint, level int, index bigint, digest binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one tree and block; they follow each other."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # blocks of one tree follow each other, so a change of either is a change of the pair
        tree, block = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
        at = 0
        for i in range(batch.num_rows):
            key = tree[i], block[i]
            if key != now:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, now = [], i, key
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _levels(total: int, block_levels: int) -> int:
    """Levels of a builder: all, where one builder has the whole tree."""
    return min(height(total), block_levels)


def _build_blocks(block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            total = table.column("total")[0].as_py()
            digests = [d.hex().encode() for d in table.column("digest").to_pylist()]
            nodes = [bytes.fromhex(n.decode()) for _, _, n in completed(digests, _levels(total, block_levels))]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("tree")[:1].combine_chunks(), table.column("block")[:1].combine_chunks(), pa.array([total]),
                    pa.array([nodes[-1]]), pa.array([b"".join(nodes)]),
                    pa.array([table.column("key").to_pylist()], pa.list_(pa.int64())),
                    pa.array([table.column("claim").to_pylist()], pa.list_(pa.binary())),
                ],
                names=["tree", "block", "total", "root", "nodes", "keys", "claims"],
            )

    return run


def _build_upper(block_levels: int, below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            tree, block, total = (table.column(c)[0].as_py() for c in ("tree", "block", "total"))
            at_level = -(-total >> below)
            digests = [d.hex().encode() for d in table.column("digest").to_pylist()]
            made = completed(digests, _levels(at_level, block_levels))
            found = [(k, (block << block_levels >> k) + i, bytes.fromhex(n.decode())) for k, i, n in made if k]
            level, index, digest = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree] * len(found)), pa.array([total] * len(found)), pa.array([below + k for k in level], pa.int32()),
                    pa.array(index, pa.int64()), pa.array(digest, pa.binary()),
                ],
                names=["tree", "total", "level", "index", "digest"],
            )

    return run


def _dealt(rows: DataFrame, block_levels: int) -> DataFrame:
    """Rows by builder, in order."""
    rows = rows.withColumn("block", F.shiftright("index", block_levels))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")


def write_log(rows: DataFrame, path: str, block_levels: int = BLOCK_LEVELS) -> None:
    """Write the log of all trees of ``rows``: tree, index (from 0), total (leaves of the tree), digest, key, claim."""
    spark = rows.sparkSession
    built = map_arrow(_dealt(rows, block_levels), _build_blocks(block_levels), _BLOCKS)
    built.write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    most = blocks.agg(F.max("total")).first()[0] or 0
    tops = blocks.select("tree", "total", F.lit(block_levels).alias("level"), F.col("block").alias("index"), F.col("root").alias("digest"))
    spark.createDataFrame([], _UPPER).write.mode("overwrite").parquet(f"{path}/upper")
    below = block_levels
    while most > 1 << below:
        # the nodes that the builders below ended with, in trees that go on
        tier = map_arrow(_dealt(tops.where(F.col("total") > 1 << below), block_levels), _build_upper(block_levels, below), _UPPER)
        tier.write.mode("append").parquet(f"{path}/upper")
        below += block_levels
        tops = spark.read.schema(_UPPER).parquet(f"{path}/upper").where(F.col("level") == below)
    upper = spark.read.schema(_UPPER).parquet(f"{path}/upper")
    ends = upper.where("shiftright(total - 1, level) = 0").select("tree", "total", "digest")
    single = blocks.where(F.col("total") <= 1 << block_levels).select("tree", "total", F.col("root").alias("digest"))
    single.unionByName(ends).write.mode("overwrite").parquet(f"{path}/roots")


def write_manifest(rows: DataFrame, path: str, block_levels: int = BLOCK_LEVELS) -> None:
    """Write the logs of all ``leaves`` below ``path``."""
    spark = rows.sparkSession
    # hashed once; nulls of doc_id take part in the order
    rows = materialize(rows.withColumn("at", F.struct(F.col("doc_id").isNotNull(), "doc_id")), "leaves")
    numbered = sequence_numbers(rows, "tree", "at", "leaf")
    totals = rows.groupBy("tree").agg(F.count("*").alias("total"))
    numbered = numbered.join(totals, "tree").select(
        "tree", (F.col("seq") - 1).alias("index"), "total", F.col("leaf").alias("digest"), F.col("doc_id").alias("key"), "claim"
    )
    write_log(numbered, f"{path}/docs", block_levels)
    roots = spark.read.parquet(f"{path}/docs/roots").select(F.lit("").alias("all"), "tree", "digest")
    ranked = materialize(sequence_numbers(roots, "all", "tree", "digest"), "ranked")
    ranked = ranked.select("tree", (F.col("seq") - 1).alias("index"), "digest")
    ranked.write.mode("overwrite").parquet(f"{path}/languages")
    top = ranked.select(
        F.lit("").alias("tree"), "index", F.lit(ranked.count()).cast("bigint").alias("total"), "digest",
        F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("binary").alias("claim"),
    )
    write_log(top, f"{path}/top", block_levels)


# -- proofs --------------------------------------------------------------------------------------------------


def _above(spark: SparkSession, path: str, block_levels: int) -> DataFrame:
    """tree, block and above (level and digest of each sibling above the block, by level), for blocks that have any."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    upper = spark.read.schema(_UPPER).parquet(f"{path}/upper")

    def placed(leaves: str, level: str, index: str) -> Column:
        last = f"(least(shiftleft({index} + 1, {level}), {leaves}) - 1)"
        return F.expr(f"2 * {last} - bit_count({last}) + {level}")

    block_roots = blocks.select("tree", "total", F.lit(block_levels).alias("level"), F.col("block").alias("index"), F.col("root").alias("digest"))
    log = upper.unionByName(block_roots).select("tree", placed("total", "level", "index").alias("position"), "digest")
    more = blocks.where(F.col("total") > 1 << block_levels).select("tree", "block", "total")
    # levels from the blocks' to the last that has two nodes
    last = F.expr("length(bin(total - 1)) - 1")
    asked = more.select("*", F.explode(F.sequence(F.lit(block_levels), last)).alias("level"))
    asked = asked.withColumn("other", F.expr(f"shiftright(block, level - {block_levels}) ^ 1"))
    # a node that would begin beyond the last leaf is none
    asked = asked.where("shiftleft(other, level) < total")
    asked = asked.select("tree", "block", "level", placed("total", "level", "other").alias("position"))
    found = asked.join(log, ["tree", "position"])
    # at most one for each level
    return found.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("level", "digest"))).alias("above"))


def _block_paths(row: dict, block_levels: int) -> Iterator[tuple[int, int | None, bytes, bytes, list[bytes | None]]]:
    """Index, key, leaf, claim and the siblings on every level (none for a single node) of the leaves of a block."""
    total, keys = row["total"], row["keys"]
    nodes = row["nodes"]
    digests = [nodes[i : i + 32].hex().encode() for i in range(0, len(nodes), 32)]
    first = row["block"] << block_levels
    begin = int(2 * first - first.bit_count())
    index = np.arange(first, first + len(keys), dtype=np.int64)
    inside, high = _levels(total, block_levels), dict((a["level"], a["digest"].hex().encode()) for a in row["above"] or ())
    own = position(total, 0, index) - begin
    places = []
    for level in range(inside):
        other = sibling(total, level, index >> level)
        places.append(np.where(other < 0, -1, position(total, level, np.maximum(other, 0)) - begin))
    places = np.stack(places, axis=1) if places else np.zeros((len(keys), 0), np.int64)
    above = [high.get(level) for level in range(inside, height(total))]
    for i, key, at, claim, of in zip(index.tolist(), keys, own.tolist(), row["claims"], places.tolist()):
        leaf = digests[at]
        yield i, key, leaf, leaf if claim is None else claim.hex().encode(), [digests[p] if p >= 0 else None for p in of] + above


def fold(node: bytes, index: int, siblings: list[bytes | None]) -> bytes:
    """The root that a node and its siblings give."""
    for level, other in enumerate(siblings):
        if other is None:
            node = _hash(node)
        else:
            node = _hash(other + node if index >> level & 1 else node + other)
    return node


def _packed(siblings: list[bytes | None]) -> list[bytes | None]:
    return [None if s is None else bytes.fromhex(s.decode()) for s in siblings]


def _paths(block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(i, key, leaf, _packed(path)) for i, key, leaf, _, path in _block_paths(row, block_levels)]
                index, keys, leaf, siblings = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(found)), pa.array(index, pa.int64()), pa.array(keys, pa.int64()),
                        pa.array([x.decode() for x in leaf]), pa.array(siblings, pa.list_(pa.binary())),
                    ],
                    names=["tree", "index", "key", "leaf", "siblings"],
                )

    return run


def _with_above(spark: SparkSession, path: str, block_levels: int) -> DataFrame:
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return blocks.join(_above(spark, path, block_levels), ["tree", "block"], "left")


def paths(spark: SparkSession, path: str, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """tree, index, key, leaf and siblings (one for each level, null for none) of every leaf of one log."""
    schema = "tree string, index bigint, key bigint, leaf string, siblings array<binary>"
    return map_arrow(_with_above(spark, path, block_levels), _paths(block_levels), schema)


def _audit(block_levels: int):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rank, root = row["rank"], row["whole"].hex().encode()
                top = [None if s is None else s.hex().encode() for s in row["top"]]
                out = []
                for i, key, leaf, claim, path in _block_paths(row, block_levels):
                    proof = _hash(b"".join(s for s in (*path, *top) if s is not None))
                    folded = fold(fold(claim, i, path), rank, top)
                    out.append((key, leaf.decode(), proof.decode(), folded.decode(), folded == root))
                key, leaf, proof, folded, same = zip(*out)
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.int64()), pa.array(leaf), pa.array([row["subroot"].hex()] * n), pa.array([root.decode()] * n),
                        pa.array(proof), pa.array(folded), pa.array(same),
                    ],
                    names=names,
                )

    return run


def audit(spark: SparkSession, path: str, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every document with its proof and the root that its claim and the logged siblings give.

    doc_id, leaf, subroot (of its language), root, proof_sha256 (hash of all siblings, from the leaf up), folded_root and
    verified (folded_root is the root).
    """
    tops = paths(spark, f"{path}/top", block_levels).select("index", F.col("siblings").alias("top"))
    languages = spark.read.parquet(f"{path}/languages")
    whole = spark.read.parquet(f"{path}/top/roots").select("digest").scalar()
    # one row for each language
    languages = languages.join(tops, "index").select(
        "tree", F.col("index").alias("rank"), F.col("digest").alias("subroot"), "top", whole.alias("whole")
    )
    # what stands above meets the block's key first, the packed nodes last
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/docs/blocks")
    keys = blocks.select("tree", "block").join(languages, "tree")
    rows = blocks.join(keys.join(_above(spark, f"{path}/docs", block_levels), ["tree", "block"], "left"), ["tree", "block"])
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return map_arrow(rows, _audit(block_levels), schema)


def every_seventh() -> Column:
    """Rows whose crc32 of the decimal doc_id is divisible by 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def audit_altered(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``audit`` of documents of which every seventh comes back with one added to n_chars."""
    spark = docs.sparkSession
    path = workspace(spark, "manifest")
    longer = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    write_manifest(leaves(docs, every_seventh(), n_chars=longer), path, block_levels)
    return audit(spark, path, block_levels)
