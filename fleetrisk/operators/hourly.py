"""Hourly aggregation of raw readings (AG1, AG2, AG3, JN1).

One ``groupBy(inverter_id, hour)`` with rule-driven aggregates. Spark plans it
as partial (map-side) + final HashAggregate, so a hot inverter is combined
before the shuffle and the shuffle carries at most one row per
(task, inverter, hour). Metadata is functionally dependent on ``inverter_id``
(the id is composed from it), so it rides along as extra grouping keys of the
same aggregate instead of a second groupBy plus join; this also keeps every
aggregation buffer fixed-width, so Spark uses HashAggregate, not SortAggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.timefns import hour_bucket
from ..schema import META_COLS

GROUP_KEYS = ["inverter_id", "datetime"]


# Fixed values (AG2): a name's aggregate is that of the first of these parts which it holds; means otherwise.
AGGREGATES = {"alarm": "max", "kwh_total": "last", "kwh_today": "last", "op_state": "max"}


def aggregate_expr(c: str) -> Column:
    """AG2: the hourly aggregate of column ``c``, in batch and streaming plans alike."""
    how = next((rule for part, rule in AGGREGATES.items() if part in c), "mean")
    # last: the latest non-NULL value of the hour; its ordering key has a fixed width, so
    # the aggregate stays a (partial + final) HashAggregate
    made = {"max": F.max, "mean": F.avg, "last": lambda x: F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col("datetime")))}
    return made[how](c).alias(c)


def numeric_signal_columns(df: DataFrame) -> list[str]:
    skip = set(META_COLS) | {"datetime"}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in skip]


def first_metadata(readings: DataFrame, meta: list[str]) -> DataFrame:
    """JN1: one row per inverter with its earliest non-NULL value of each metadata column (least value on ties).

    Readings are first reduced to their distinct combinations, before any shuffle.
    """
    seen = (readings.where(F.col("inverter_id").isNotNull() & F.col("datetime").isNotNull())
            .groupBy("inverter_id", *meta).agg(F.min("datetime").alias("_seen")))
    return seen.groupBy("inverter_id").agg(
        *[F.min(F.when(F.col(c).isNotNull(), F.struct("_seen", c)))[c].alias(c) for c in meta])


def aggregate_hourly(readings: DataFrame, extra_keys: list[str] | None = None, metadata: str = "keys") -> DataFrame:
    """Raw readings -> one row per (inverter_id, hour).

    Rows with a missing inverter id or timestamp are dropped first (AG3).
    Output layout: keys, aggregated signals in input order, then metadata.
    ``metadata="first"`` joins ``first_metadata`` on, for ids that don't fix their metadata.
    """
    extra = list(extra_keys or [])
    signals = [c for c in numeric_signal_columns(readings) if c not in extra]
    meta = [c for c in META_COLS if c in readings.columns and c != "inverter_id"] + extra
    keyed = (readings
             .where(F.col("inverter_id").isNotNull() & F.col("datetime").isNotNull())
             .withColumn("hour_bucket", hour_bucket("datetime")))
    aggs = [aggregate_expr(c) for c in signals]
    if metadata == "first":
        hours = keyed.groupBy("inverter_id", "hour_bucket", *extra).agg(*aggs)
        out = hours.join(first_metadata(readings, [c for c in meta if c not in extra]), "inverter_id", "left")
    else:
        out = keyed.groupBy("inverter_id", "hour_bucket", *meta).agg(*aggs)
    return out.select("inverter_id", F.col("hour_bucket").alias("datetime"), *signals, *meta)
