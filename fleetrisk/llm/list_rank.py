"""Distributed ranking of a linked list, and prefix sums along it.

Ranking contracts the list: in a round every element tosses a coin by hash, and an element that tossed 1 behind one that tossed 0 is
absorbed by it, a fourth of the list in expectation. What is left once ``base`` elements remain is walked in one task, then the rounds
are undone in reverse (Anderson and Miller, "Deterministic parallel list ranking", 1991, with coins). A round is one join on unique keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash

#: Elements of a contracted list that one task walks.
BASE = 50_000
#: Positions whose prefix sums one window holds.
BLOCK = 65_536


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole (contracted, bounded) list: positions from its start, the one element that nothing precedes."""
    after: dict[bytes, tuple[bytes | None, int]] = {}
    for b in batches:
        for i, s, w in zip(*(b.column(c).to_pylist() for c in ("id", "succ", "w"))):
            after[i] = (s, w)
    if not after:
        return
    starts = set(after) - {s for s, _ in after.values()}
    if len(starts) != 1:
        raise ValueError("not one linked list")
    at, pos, ids, out = starts.pop(), 0, [], []
    while at is not None:
        ids.append(at)
        out.append(pos)
        at, w = after.pop(at)
        pos += w
    if after:
        raise ValueError("not one linked list")
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.int64())], names=["id", "pos"])


def list_rank(elements: DataFrame, base: int = BASE, max_rounds: int = 120) -> DataFrame:
    """``elements`` (id binary, succ binary, w long), one linked list -> (id, pos): the sum of the weights before the element.

    Ids are unique; the last element's ``succ`` is null. An empty table gives an empty one; anything else than one list raises.
    """
    level = stash(elements.select("id", "succ", "w"), "list")
    n, levels = level.count(), []
    while n > base:
        r = len(levels)
        if r == max_rounds:
            raise RuntimeError(f"the list did not contract in {max_rounds} rounds")
        coin = F.pmod(F.xxhash64(F.lit(r), "id"), F.lit(2))
        heads = level.where(coin == 0)
        tails = level.where(coin == 1).select(F.col("id").alias("t_id"), F.col("succ").alias("t_succ"), F.col("w").alias("t_w"))
        met = F.col("id").isNotNull() & F.col("t_id").isNotNull()
        done = stash(heads.join(tails, F.col("succ") == F.col("t_id"), "full").select(
            F.coalesce("id", "t_id").alias("id"),
            F.when(F.col("t_id").isNull(), F.col("succ")).otherwise(F.col("t_succ")).alias("succ"),
            (F.coalesce("w", F.lit(0)) + F.coalesce("t_w", F.lit(0))).alias("w"),
            F.when(met, F.col("t_id")).alias("gone"), F.when(met, F.col("w")).alias("behind")), "list")
        discard(level)
        levels.append(done)
        level = done.select("id", "succ", "w")
        n = done.count()
    pos = level.select("id", "succ", "w").repartition(1).mapInArrow(_walk, "id binary, pos long")
    for done in reversed(levels):
        both = done.select("id", "gone", "behind").join(pos, "id")
        each = F.array(F.struct("id", "pos"), F.struct(F.col("gone").alias("id"), (F.col("pos") + F.col("behind")).alias("pos")))
        pos = stash(both.select(F.explode(each).alias("e")).select("e.*").where("id is not null"), "list-pos")
    return pos


def prefix_sums(rows: DataFrame, pos: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over all rows at ``pos`` and before; ``pos`` is dense from 0.

    Windows hold a block of positions; what stands before a block comes from block totals, a ``block``-th of the rows.
    """
    cut = rows.withColumn("_block", F.floor(F.col(pos) / F.lit(block)))
    own = cut.select("*", *(F.sum(c).over(Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)).alias(k)
                            for k, c in sums.items()))
    totals = cut.groupBy("_block").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = totals.select("_block", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    out = own.join(totals, "_block")
    for k in sums:
        out = out.withColumn(k, F.col(k) + F.col(f"_{k}"))
    return out.drop("_block", *(f"_{k}" for k in sums))
