"""Mixing sources to target weights.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their sources); a min-cost
flow routes the words of each pattern to the quotas of its sources, where every further repetition of a pattern's
words costs more than the one before. The flow says how many words of each pattern the mix takes; documents are then
taken in a seeded order, whole, up to that number, and one document more or fewer per pattern where that comes nearer.

Sources and patterns may be many. The driver holds one number for each distinct size of a source, to find the level of
the quotas. A source whose documents belong to no other gets its quota without a flow; the rest is routed by connected
part, each part in one task, whose time grows with the square of the patterns in the part.

A null text has size 0 and a null source is a source of its own, last in order. Documents of size 0 add no words.
Repeated rows are taken or left alike. An empty input gives an empty table. Extra columns are not read, or kept
unchanged by ``take``.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from weftmark.functions.ordering import sequence_numbers
from weftmark.llm.batches import own_columns, set_aside, slots, text_key
from weftmark.llm.components import components
from weftmark.session import materialize, ship_package

WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)
REPEATS = 2
SEED = 9
# documents of a pattern whose sizes are summed in order in one window
ROWS_EACH = 100_000
FIX_ROUNDS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def share_level(counts: dict[tuple[int, int], int], budget: Fraction = BUDGET, stop: int = REPEATS) -> Fraction | None:
    """Words for each unit of weight when no source gets over ``stop`` times its size; None if all sources stop there.

    ``counts`` has the number of sources of each (size, weight).
    """
    left = budget * sum(size * n for (size, _), n in counts.items())
    rest = sum(weight * n for (_, weight), n in counts.items())
    unit = math.lcm(*(weight for _, weight in counts))
    for (size, weight), n in sorted(counts.items(), key=lambda c: c[0][0] * (unit // c[0][1])):
        if stop * size * rest >= left * weight:
            return left / rest
        left -= stop * size * n
        rest -= weight * n
    return None


def source_targets(
    sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, stop: int = REPEATS
) -> dict[str | None, Fraction]:
    """Share ``budget`` times all words by weight; no source gets over ``stop`` times its size, the rest is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    level = share_level(Counter((sizes[s], weight[s]) for s in names), budget, stop)
    most = {s: Fraction(stop * sizes[s]) for s in names}
    return {s: most[s] if level is None else min(most[s], level * weight[s]) for s in names}


def route_words(
    patterns: dict[str, int], members: dict[str, list], quotas: dict[str | None, int], repeats: int = REPEATS
) -> dict[tuple[str, str | None], int]:
    """Min-cost flow from pattern words to source quotas; the k-th repetition of a pattern costs k for each word.

    Successive cheapest paths, each filled to its narrowest edge. Ties go to the first edge in order, so that the result
    depends on the numbers alone.
    """
    graph: dict = {}
    edges: list[list] = []  # to, room, cost; the reverse edge follows each

    def connect(a, b, room: int, cost: int) -> int:
        for at, to, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            graph.setdefault(at, []).append(len(edges))
            edges.append([to, r, c])
        return len(edges) - 2

    start, goal = ("start",), ("goal",)
    graph[start], graph[goal] = [], []
    routes = {}
    for p in sorted(patterns):
        for k in range(repeats):
            connect(start, ("pattern", p), patterns[p], k)
        for s in members[p]:
            routes[p, s] = connect(("pattern", p), ("source", s), repeats * patterns[p], 0)
    for s, quota in quotas.items():
        connect(("source", s), goal, quota, 0)
    while True:
        cost, came, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            at = queue.popleft()
            queued.discard(at)
            for e in graph[at]:
                to, room, c = edges[e]
                if room and (to not in cost or cost[at] + c < cost[to]):
                    cost[to], came[to] = cost[at] + c, (at, e)
                    if to not in queued:
                        queue.append(to)
                        queued.add(to)
        if goal not in came:
            break
        path, at = [], goal
        while at != start:
            at, e = came[at]
            path.append(e)
        narrow = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= narrow
            edges[e ^ 1][1] += narrow
    return {key: edges[e ^ 1][1] for key, e in routes.items() if edges[e ^ 1][1]}


def _keyed(docs: DataFrame, by: str, seed: int) -> DataFrame:
    """Add key, pattern and seeded place; the column ``by`` has a document's source or an array of its sources."""
    members = F.col(by)
    if not isinstance(docs.schema[by].dataType, ArrayType):
        members = F.array(members.cast("string"))
    # an array that is null or empty is that of the null source
    members = F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string")))
    return docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).select(
        "*",
        F.to_json(F.array_sort(F.array_distinct(members))).alias("_pattern"),
        text_key().alias("_row_key"),
    ).withColumn("_place", F.xxhash64(F.lit(seed), "doc_id", "_row_key"))


def _with_targets(sources: DataFrame, repeats: int) -> DataFrame:
    """Add target and quota (whole words) to sources with their sizes, as ``source_targets`` does."""
    numbered = sequence_numbers(sources.withColumn("_all", F.lit(0)), "_all", "source", "size", "_place")
    place = F.coalesce(F.col("_place"), F.lit(sources.count())) - 1
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(place, F.lit(len(WEIGHTS))).cast("int"))
    weighed = materialize(numbered.withColumn("weight", weight).drop("_all", "_place"), "sources")
    counts = {(r["size"], r["weight"]): r["count"] for r in weighed.groupBy("size", "weight").count().collect()}
    level = share_level(counts, stop=repeats)
    most = repeats * F.col("size")
    target, quota = most.cast("double"), most
    if level is not None:
        for w in sorted(set(WEIGHTS)):
            shared = (F.col("weight") == w) & (most >= math.ceil(level * w))
            target = F.when(shared, F.lit(float(level * w))).otherwise(target)
            quota = F.when(shared, F.lit(int(level * w)).cast("bigint")).otherwise(quota)
    return weighed.select("source", "size", "patterns", target.alias("target"), quota.alias("quota"))


_ROUTED = (
    "_pattern string, words bigint, taken bigint, routes array<struct<source:string,words:bigint>>, "
    "source_size bigint, target double"
)


def _route_part(repeats: int):
    """The flow of one connected part, from rows of (pattern, source)."""
    schema = pa.schema([
        ("_pattern", pa.string()), ("words", pa.int64()), ("taken", pa.int64()),
        ("routes", pa.list_(pa.struct([("source", pa.string()), ("words", pa.int64())]))),
        ("source_size", pa.int64()), ("target", pa.float64()),
    ])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["_pattern"], r["source"] is None, r["source"] or ""))
        words: dict[str, int] = {}
        members: dict[str, list] = {}
        quotas: dict[str | None, int] = {}
        alone: dict[str, dict] = {}
        for r in rows:
            words[r["_pattern"]] = r["words"]
            members.setdefault(r["_pattern"], []).append(r["source"])
            quotas[r["source"]] = r["quota"]
            if r["width"] == 1:
                alone[r["_pattern"]] = r
        flow = route_words(words, members, quotas, repeats)
        out = []
        for p, sources in members.items():
            routes = [{"source": s, "words": flow.get((p, s), 0)} for s in sources]
            own = alone.get(p, {})
            out.append({
                "_pattern": p, "words": words[p], "taken": sum(r["words"] for r in routes), "routes": routes,
                "source_size": own.get("size"), "target": own.get("target"),
            })
        return pa.Table.from_pylist(out, schema)

    return run


def _route_patterns(found: DataFrame, repeats: int) -> DataFrame:
    """Words taken of each pattern and their sources, from the words of each pattern."""
    found = materialize(found.withColumn("_members", F.from_json("_pattern", "array<string>")), "patterns")
    links = found.select("_pattern", "words", F.size("_members").alias("width"), F.explode("_members").alias("source"))
    sources = materialize(links.groupBy("source").agg(F.sum("words").alias("size"), F.count("*").alias("patterns")), "sources")
    targets = _with_targets(sources, repeats).withColumnRenamed("source", "_source")
    asked = materialize(links.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "routes")
    # a pattern of one source that has no other pattern
    sole = (F.col("width") == 1) & (F.col("patterns") == 1)
    routed = asked.where(sole).select(
        "_pattern", "words", F.col("quota").alias("taken"),
        F.array(F.struct("source", F.col("quota").alias("words"))).alias("routes"), F.col("size").alias("source_size"), "target",
    )
    shared = asked.where(~sole)
    if shared.isEmpty():
        return routed
    # equal hashes would only put two parts into one
    node = F.xxhash64(F.lit(1), "source")
    roots = components(shared.select(node.alias("a"), F.xxhash64(F.lit(2), "_pattern").alias("b")))
    parts = shared.withColumn("node", node).join(roots, "node").drop("node")
    ship_package(found.sparkSession)
    return routed.unionByName(parts.groupBy("root").applyInArrow(_route_part(repeats), _ROUTED))


def plan_mix(docs: DataFrame, by: str = "source", seed: int = SEED, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents, and one row for each pattern that says which of its documents are taken how often.

    The decision of a pattern: every document ``base`` times, those up to (``cut_cell``, ``cut_place``) in seeded order
    once more, and the few named in ``fixes`` once more or less. ``routes`` has the words that each source gets.
    """
    keyed = _keyed(own_columns(docs, "doc_id", "text", by), by, seed)
    sizes = materialize(
        keyed.select("doc_id", "_row_key", "_pattern", "_place", word_count().alias("size")), "sizes"
    )
    number = slots(sizes, ROWS_EACH)
    sizes = sizes.withColumn("_cell", F.pmod("_place", F.lit(number)))
    cells = materialize(sizes.groupBy("_pattern", "_cell").agg(F.sum("size").alias("words")), "cells")

    routed = _route_patterns(cells.groupBy("_pattern").agg(F.sum("words").alias("words")), repeats)
    base = F.when(F.col("words") > 0, F.expr("taken div words")).otherwise(F.lit(0).cast("bigint"))
    patterns = materialize(
        routed.withColumn("base", base).select(
            "_pattern", "base", (F.col("taken") - F.col("base") * F.col("words")).alias("rest"), "routes", "source_size", "target"
        ),
        "patterns",
    )

    # the cell of each pattern in which the rest ends, and the place in it
    before = Window.partitionBy("_pattern").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends_in = starts.join(patterns, "_pattern").where(
        (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words"))
    ).select("_pattern", "_cell", "start", "rest")
    # by cell too, as the join before it: one cell of each pattern
    order = Window.partitionBy("_pattern", "_cell").orderBy("_place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    cuts = (
        sizes.join(ends_in, ["_pattern", "_cell"])
        .withColumn("middle", middle)
        .groupBy("_pattern")
        .agg(
            F.first("_cell").alias("cut_cell"),
            F.max(F.when(F.col("middle") < F.col("rest"), F.col("_place"))).alias("cut_place"),
            (F.first("rest") - F.first("start") - F.coalesce(F.sum(F.when(F.col("middle") < F.col("rest"), F.col("size"))), F.lit(0))).alias("missing"),
        )
    )
    mix = patterns.join(cuts, "_pattern", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    none = F.array().cast("array<struct<doc:bigint,key:bigint,by:bigint>>")
    mix = materialize(mix.withColumn("fixes", none), "mix")

    # one document more or fewer, where that comes nearer; each round about halves what is missing or better
    for _ in range(FIX_ROUNDS):
        gap = F.abs("missing")
        off = F.abs(gap - F.col("size"))
        usable = F.when(F.col("missing") > 0, F.col("copies") < repeats).otherwise(F.col("copies") > 0)
        best = (
            _decided(sizes, mix)
            .where(usable & (off < gap))
            .groupBy("_pattern")
            .agg(F.min(F.struct(off.alias("off"), "_place", "doc_id", "_row_key", "size")).alias("best"))
        )
        by = F.signum("missing").cast("bigint")
        fix = F.struct(F.col("best.doc_id").alias("doc"), F.col("best._row_key").alias("key"), by.alias("by"))
        mix = mix.join(best, "_pattern", "left").select(
            *(c for c in mix.columns if c not in ("fixes", "missing")),
            (F.col("missing") - F.coalesce(by * F.col("best.size"), F.lit(0))).alias("missing"),
            F.when(F.col("best").isNull(), F.col("fixes")).otherwise(F.array_append("fixes", fix)).alias("fixes"),
        )
        mix = materialize(mix, "mix")
    return sizes, mix


def _decided(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """Rows with the number of their copies in the mix."""
    place = F.struct("_cell", "_place")
    cut = F.when(place <= F.struct("cut_cell", "cut_place"), 1).otherwise(0)

    def by(total, fix):
        same = fix["doc"].eqNullSafe(F.col("doc_id")) & (fix["key"] == F.col("_row_key"))
        return total + F.when(same, fix["by"]).otherwise(0)

    fixed = F.aggregate("fixes", F.lit(0).cast("bigint"), by)
    return rows.join(mix, "_pattern").withColumn("copies", F.col("base") + cut + fixed)


def mix_by_source(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of documents with one source each."""
    sizes, mix = plan_mix(docs, "source", seed)
    return _decided(sizes, mix).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_by_sources(docs: DataFrame, by: str = "sources", seed: int = SEED) -> DataFrame:
    """doc_id, pattern, size, routes and taken of documents that may belong to several sources.

    ``routes`` has the words that each source gets from all documents of the pattern.
    """
    sizes, mix = plan_mix(docs, by, seed)
    return _decided(sizes, mix).select(
        "doc_id", F.col("_pattern").alias("pattern"), "size", "routes", (F.col("copies") * F.col("size")).alias("taken")
    )


def take(docs: DataFrame, by: str = "source", seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    sizes, mix = plan_mix(docs, by, seed)
    number = slots(sizes, ROWS_EACH)
    rows, restore = set_aside(docs, "doc_id", "text", by)
    rows = _keyed(rows, by, seed).withColumn("_cell", F.pmod("_place", F.lit(number)))
    decided = _decided(rows, mix.drop("source_size", "target", "routes"))
    repeated = decided.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return restore(repeated)
