"""Positions, latest / last-N readings, top-k and stable sampling (WN6-WN8, SK1-SK6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import chunking as ch
from .stats import bucketed_prefix


def global_positions(df: DataFrame, key: str = "inverter_id", order: str = "datetime",
                     out: str = "row_pos") -> DataFrame:
    """WN8: position in the (key, order) sort of the whole table.

    = per-entity position + rows of all entities sorting before it. The entity
    offsets are a distributed prefix sum over the per-entity count table: it is
    range-partitioned by key, the (order-preserving) partition index is the
    bucket, bucket totals are prefix-summed and each bucket ranks its own keys.
    """
    pos = ch.add_positions(df, key=key, order=order)
    counts = pos.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counts.repartitionByRange(key).withColumn("_rb", F.spark_partition_id())
    offsets = bucketed_prefix(ranged, key, ["_n"], F.col("_rb")).select(key, F.col("_n_before").alias("_eoff"))
    return (pos.join(offsets, key)
            .withColumn(out, (F.col("_eoff") + F.col(ch.POS)).cast("long"))
            .drop("_eoff", ch.POS))


def time_positions(df: DataFrame, key: str = "inverter_id", order: str = "datetime", out: str = "row_pos") -> DataFrame:
    """Position in the (order, key) sort of the whole table: all entities' rows in time order.

    Rows are counted by time, and the counts are summed up over ranges of the times (written, with their range's number); the rows of one time are
    ranked by key. No window holds more than a range of times or the rows of one time.
    """
    times = materialize(df.groupBy(order).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(order).withColumn("_rb", F.spark_partition_id()))
    before = bucketed_prefix(times, order, ["_n"], F.col("_rb")).select(order, F.col("_n_before").alias("_before"))
    inside = Window.partitionBy(order).orderBy(key)
    return df.join(before, order).withColumn(out, (F.col("_before") + F.row_number().over(inside) - 1).cast("long")).drop("_before")


def latest_per_entity(df: DataFrame, key: str = "inverter_id", order: str = "datetime") -> DataFrame:
    """WN6: the latest row of every entity; each task keeps one row per entity before the shuffle (window group limit)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_n_per_entity(df: DataFrame, n: int, key: str = "inverter_id", order: str = "datetime",
                      out: str = "reading_no") -> DataFrame:
    """WN7: the last ``n`` rows of every entity, numbered 0.. in ascending time; at most n rows per entity and task are shuffled."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    kept = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return kept.withColumn(out, F.max("_rn").over(Window.partitionBy(key)) - F.col("_rn")).drop("_rn")


def top_k(df: DataFrame, k: int, by: Sequence[Column]) -> DataFrame:
    """SK2/SK4: distributed top-k (per-partition k, then a k-row merge)."""
    return df.orderBy(*by).limit(k)


def shuffle_order(keys: Sequence[str], seed: int) -> Column:
    """A seeded order that any engine can repeat: md5 of the keys as text and the seed, joined by bars."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def stable_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """SK6: deterministic sample of ``n`` rows: the first in the seeded order of their keys."""
    return df.orderBy(shuffle_order(keys, seed), *keys).limit(n)


def readings_of(df: DataFrame, entity: str, key: str = "inverter_id", order: str = "datetime") -> DataFrame:
    """PRJ13: one entity's readings in time order (the filter reaches the parquet scan)."""
    return df.where(F.col(key) == F.lit(entity)).orderBy(order)
