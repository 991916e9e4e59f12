"""Pipeline A: raw readings -> hourly -> featured table (time, rolling, alarm, KPI, targets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kpi
from ..operators import chunking as ch
from ..operators.features import (PLAIN, OrderSpec, add_alarm_features, add_kpi_features,
                                  add_rolling_features, add_targets, add_time_features, trailing_mean)
from ..session import materialize
from ..operators.hourly import aggregate_hourly
from ..schema import WINDOWS
from ..sources.events_fixture import load_readings

# Rows per window chunk on the scale path. An hourly inverter history of ~11
# months fits one chunk; longer histories (or a hot entity) are split.
DEFAULT_CHUNK_ROWS = 8192
TRAIL_ROWS = max(WINDOWS.values())


def _features(df: DataFrame, window_days: int, spec: OrderSpec, carry_col: str | None = None,
              keep_events: bool = False, engine: str = "window") -> DataFrame:
    df = add_time_features(df)
    if engine == "pandas":
        # Spark windows first (alarm prefix sums, the one 24-row power mean the
        # labels need, forward label sums), then the pandas rolling kernel: it
        # groups by the same keys the windows already partitioned and sorted
        # on, so the whole stage runs after a single shuffle.
        df = add_alarm_features(df, spec, carry_col)
        df = df.withColumn("_p24", trailing_mean("inv_power", 24, spec)) if "inv_power" in df.columns else df
        df = add_targets(df, window_days, spec, keep_events, mean24="_p24")
        df = add_rolling_features(df, spec, "pandas")
        df = add_kpi_features(df)
        return df.drop("_p24")
    if engine == "none":
        # alarms, events and labels only: windows and the one mean they need, no Python
        df = add_alarm_features(df, spec, carry_col)
        if "inv_power" in df.columns:
            df = df.withColumn("inv_power_24h_mean", trailing_mean("inv_power", 24, spec))
        return add_kpi_features(add_targets(df, window_days, spec, keep_events))
    df = add_rolling_features(df, spec, engine)
    df = add_alarm_features(df, spec, carry_col)
    df = add_kpi_features(df)
    return add_targets(df, window_days, spec, keep_events)


def _canonical(df: DataFrame, hourly_cols: list[str]) -> DataFrame:
    """Column order: hourly, time, rolling, alarm, KPI, (events,) targets."""
    first = [c for c in hourly_cols if c in df.columns]
    time = ["hour", "day_of_week", "month", "is_daytime"]
    rolling = [c for c in df.columns if c.endswith(("_mean", "_std")) and c not in first]
    alarm = ["alarm_active", "alarm_count_24h", "alarm_count_7d", "hours_since_last_alarm"]
    kpis = ["voltage_imbalance", "pf_deviation", "freq_deviation", "power_ratio_vs_24h", "smu_zero_fraction"]
    tail = [c for c in ["shutdown_event", "degradation_event", "target_binary", "target_multiclass"] if c in df.columns]
    order = first + time + rolling + alarm + kpis + tail
    return df.select(*order, *[c for c in df.columns if c not in set(order)])


def featurize(hourly: DataFrame, window_days: int = 7, chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
              key: str = "inverter_id", keep_events: bool = False, engine: str | None = None) -> DataFrame:
    """Run the full feature stage on an hourly table.

    ``chunk_rows=None`` partitions windows by inverter (one task per inverter);
    an integer cuts every inverter's history into halo chunks (task size
    bounded by ``chunk_rows + 167 + window_days*24 - 1`` rows). Rolling mean/std
    use Spark frames (``engine="window"``) or, by default on the chunked path,
    an O(rows) pandas kernel per bounded chunk (``engine="pandas"``);
    ``engine="none"`` leaves them out but for the 24-row power mean that events and labels need.

    On the chunked path the hourly table and its positions are checkpointed
    (shared ``spark.checkpoint.dir``): both feed two branches (rows and the
    per-chunk alarm carry), which would otherwise re-run the raw aggregation.
    """
    if chunk_rows is None:
        return _canonical(_features(hourly, window_days, PLAIN, keep_events=keep_events,
                                    engine=engine or "window"), hourly.columns)
    engine = engine or "pandas"
    cols = hourly.columns
    hourly = materialize(hourly)
    pos = materialize(ch.add_positions(hourly, key=key))
    alarm_ts = F.when(kpi.alarm_active(F.col("inv_alarm_code")) == 1, F.col("datetime")) \
        if "inv_alarm_code" in cols else F.lit(None).cast("timestamp_ntz")
    carry = ch.carry_last_before(pos, chunk_rows, key, alarm_ts, "_alarm_carry")
    ahead = window_days * 24 - 1
    exploded = ch.explode_halo(pos, chunk_rows, TRAIL_ROWS - 1, ahead).join(carry, [key, ch.WCHUNK], "left")
    out = _features(exploded, window_days, ch.chunk_spec(key), "_alarm_carry", keep_events, engine)
    helper = {ch.POS, ch.CHUNK, ch.WCHUNK, ch.CORE, "_alarm_carry"}
    out = out.where(F.col(ch.CORE)).select(*[c for c in out.columns if c not in helper])
    return _canonical(out, cols)


def hourly_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_hourly(load_readings(spark, sf_dir))


def featured_from_events(spark: SparkSession, sf_dir: str, window_days: int = 7,
                         chunk_rows: int | None = DEFAULT_CHUNK_ROWS, keep_events: bool = False,
                         engine: str | None = None) -> DataFrame:
    return featurize(hourly_from_events(spark, sf_dir), window_days, chunk_rows,
                     keep_events=keep_events, engine=engine)


#: What alarms, events and labels are made of.
LABEL_INPUTS = ["inverter_id", "datetime", "inv_power", "inv_alarm_code"]


def labels_from_events(spark: SparkSession, sf_dir: str, window_days: int = 7,
                       chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Alarm features, power ratio inputs, events' inputs and targets without the rolling features."""
    hourly = hourly_from_events(spark, sf_dir)
    return featurize(hourly.select(*[c for c in LABEL_INPUTS if c in hourly.columns]), window_days, chunk_rows, engine="none")
