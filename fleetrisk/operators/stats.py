"""Distributed order statistics and prefix sums without single-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def exact_median_long(long_df: DataFrame, key: str = "feature", value: str = "value") -> DataFrame:
    """Exact median of ``value`` per ``key`` on a long (key, value) table: key, ``median``.

    Equal values collapse to counts before the shuffle, so ties cost nothing. The distinct values are cut
    into ranges of (key, value), written down with their range's number; prefix sums over the ranges' totals and, inside a
    range, over its counts give each value its ranks, and the values that hold the middle ranks are averaged.
    """
    counts = (long_df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
              .repartitionByRange(key, "_v").withColumn("_range", F.spark_partition_id()))
    counts = materialize(counts)
    totals = counts.groupBy(key, "_range").agg(F.sum("_n").alias("_t"))
    ranges = Window.partitionBy(key).orderBy("_range")  # a row per key and range
    base = totals.select(key, "_range", (F.sum("_t").over(ranges) - F.col("_t")).alias("_b"),
                         F.sum("_t").over(Window.partitionBy(key)).alias("_all"))
    # only ranges with a middle rank are sorted
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    base = base.join(totals, [key, "_range"]).where((low < F.col("_b") + F.col("_t")) & (high >= F.col("_b"))).drop("_t")
    inside = Window.partitionBy(key, "_range").orderBy("_v")
    ranked = counts.join(base, [key, "_range"]).withColumn("_to", F.col("_b") + F.sum("_n").over(inside)).withColumn("_from", F.col("_to") - F.col("_n"))
    holds = lambda r: (F.col("_from") <= r) & (r < F.col("_to"))
    return (ranked.groupBy(key).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_c"))
            .select(key, ((F.col("_a") + F.col("_c")) / 2).alias("median")))


def bucketed_prefix(df: DataFrame, order: str, sums: Sequence[str], bucket: Column,
                    partition: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over rows strictly earlier in ``order``.

    Rows are grouped into ordered buckets; bucket totals are prefix-summed on
    the (small) bucket table and each bucket's rows are ranked on their own, so
    no single task sees the whole table. ``order`` values must be distinct.
    """
    keys = list(partition)
    d = df.withColumn("_bk", bucket)
    tot = d.groupBy(*keys, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_bk", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in sums])
    wi = Window.partitionBy(*keys, "_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(off, [*keys, "_bk"])
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wi), F.lit(0))).alias(f"{c}_before")
                                     for c in sums])
