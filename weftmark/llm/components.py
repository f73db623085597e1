"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) of all nodes of ``links`` (a, b of type bigint).

    Alternates two steps until nothing changes: every node sends its larger neighbours, then its smaller ones, to the
    smallest neighbour. Each step is a grouped minimum and a join on the node, which may be skewed; the number of steps grows
    with the logarithm of the longest chain. Every step is written to the shared folder. Null nodes and loops are left out.
    """
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = materialize(pairs.distinct(), "links")
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = materialize(large.distinct(), "links")
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        pairs = materialize(small.union(lowest).distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root"))).distinct()
