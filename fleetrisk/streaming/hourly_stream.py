"""Structured Streaming variants (ST1, ST2).

ST1: raw readings arriving as a stream are aggregated into hourly rows with
an event-time watermark: ``groupBy(window(datetime, '1 hour'), inverter_id)``
with the same per-column rules as the batch hourly operator (``last`` becomes
``max_by`` on time, which streaming aggregation supports). Late readings
within the watermark update their hour; an hour is emitted once the
watermark passes its end (append mode).

ST2: a serving stream — sparse readings completed with the serving rules
(stateless, so the batch operator applies unchanged to a stream).
Row-count windows (trailing 6/24/168 rows) are not available on streams, so
the windowed features stay batch jobs over the hourly table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hourly import aggregate_expr, numeric_signal_columns
from ..operators.serving import complete_readings
from ..schema import META_COLS


def hourly_stream(readings: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """ST1: streaming hourly aggregation of raw readings (append mode)."""
    signals = numeric_signal_columns(readings)
    meta = [c for c in META_COLS if c in readings.columns and c != "inverter_id"]
    aggs = [aggregate_expr(c) for c in signals]
    ts = F.col("datetime").cast("timestamp")
    keyed = readings.withColumn("_ts", ts).withWatermark("_ts", watermark)
    out = keyed.groupBy(F.window("_ts", "1 hour").alias("_w"), "inverter_id", *meta).agg(*aggs)
    return out.select("inverter_id", F.col("_w.start").cast("timestamp_ntz").alias("datetime"), *signals, *meta)


def scoring_stream(readings: DataFrame, baseline: DataFrame) -> DataFrame:
    """ST2: sparse readings -> dense model rows, per micro-batch (stateless)."""
    return complete_readings(readings, baseline)
