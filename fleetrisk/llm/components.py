"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014): every
round is two groupings and joins, minima are combined before the shuffle, and the
rounds needed grow with the logarithm of the longest path. Links never reach the driver. The
links of a node with very many of them stay where they are: such nodes are few, and their minima are broadcast (``join_lookup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_lookup, stash


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) -> (node, component): component is the smallest node reachable.

    Loops, repeated and reversed edges and nulls are allowed (null ends are
    dropped); nodes without an edge to another node don't appear. An empty table gives an empty one.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = stash(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = join_lookup(both, low, "u", 2 * before[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = (join_lookup(large, low, "u", 2 * before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        nxt = stash(small, "edges")
        after = _state(nxt)
        discard(e)
        e = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled: every node hangs on the smallest one.
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node") \
        .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
