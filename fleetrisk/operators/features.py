"""Feature engineering operators: time, trailing-window, alarm, KPI, labels.

All row-count windows of one entity share a single (partition, order) spec, so
Catalyst plans one Exchange + one Sort for every trailing and forward frame
together. The spec is a parameter: ``("inverter_id",) / ("datetime",)`` for the
plain plan, or the chunked spec of :mod:`fleetrisk.operators.chunking`, which
bounds the rows one task holds no matter how long an inverter's history is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kpi
from ..functions.timefns import day_of_week, hours_between, is_daytime
from ..schema import NO_ALARM_HOURS, ROLLING_COLS, WINDOWS


@dataclass(frozen=True)
class OrderSpec:
    """Partition and order columns of an entity's row sequence."""
    partition: Sequence[str] = ("inverter_id",)
    order: Sequence[str] = ("datetime",)

    def window(self):
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def rows(self, start: int, end: int):
        return self.window().rowsBetween(start, end)


PLAIN = OrderSpec()


def min_periods(w: int) -> int:
    return max(1, w // 4)


# ---------------------------------------------------------------- time ---
def add_time_features(df: DataFrame) -> DataFrame:
    """FN1-FN3: hour, day_of_week (Mon=0), month, is_daytime."""
    h = F.hour("datetime")
    return df.select("*", h.alias("hour"), day_of_week(F.col("datetime")).alias("day_of_week"),
                     F.month("datetime").alias("month"), is_daytime(h).alias("is_daytime"))


# ------------------------------------------------------------- rolling ---
def trailing_mean(c: str, w: int, spec: OrderSpec = PLAIN) -> Column:
    """WN1: mean of the last ``w`` rows with at least ``max(1, w//4)`` values."""
    frame = spec.rows(-(w - 1), 0)
    return F.when(F.count(c).over(frame) >= min_periods(w), F.avg(c).over(frame))


def trailing_std(c: str, w: int, spec: OrderSpec = PLAIN) -> Column:
    """WN2: sample std of the last ``w`` rows (NULL below 2 values)."""
    frame = spec.rows(-(w - 1), 0)
    return F.when(F.count(c).over(frame) >= min_periods(w), F.stddev_samp(c).over(frame))


def rolling_columns(df: DataFrame, spec: OrderSpec = PLAIN,
                    signals: Sequence[str] = ROLLING_COLS,
                    windows: dict = WINDOWS) -> list[Column]:
    out = []
    for c in signals:
        if c not in df.columns:
            continue
        for name, w in windows.items():
            out.append(trailing_mean(c, w, spec).alias(f"{c}_{name}_mean"))
            out.append(trailing_std(c, w, spec).alias(f"{c}_{name}_std"))
    return out


def add_rolling_features(df: DataFrame, spec: OrderSpec = PLAIN, engine: str = "window") -> DataFrame:
    """WN1+WN2: 9 signals x {6, 24, 168} rows x {mean, std}.

    ``engine="window"`` uses Spark sliding frames (exact, but each output row
    re-aggregates its whole frame: O(rows x width)). ``engine="pandas"`` runs an
    O(rows) rolling kernel per window partition through ``applyInPandas``; it is
    meant for the chunked spec, whose partitions are bounded in size.
    """
    if engine == "window":
        return df.select("*", *rolling_columns(df, spec))
    if engine != "pandas":
        raise ValueError(f"unknown engine {engine!r}")
    return rolling_in_pandas(df, spec)


def _rolling_kernel(signals, windows, order):
    import pandas as pd

    def run(pdf: "pd.DataFrame") -> "pd.DataFrame":
        pdf = pdf.sort_values(list(order), kind="stable")
        out = {}
        for c in signals:
            x = pdf[c].astype("float64")
            for name, w in windows.items():
                r = x.rolling(w, min_periods=min_periods(w))
                out[f"{c}_{name}_mean"] = r.mean()
                out[f"{c}_{name}_std"] = r.std()
        return pd.concat([pdf, pd.DataFrame(out, index=pdf.index)], axis=1)
    return run


def rolling_in_pandas(df: DataFrame, spec: OrderSpec,
                      signals: Sequence[str] = ROLLING_COLS, windows: dict = WINDOWS) -> DataFrame:
    from pyspark.sql.types import DoubleType, StructField, StructType

    from ..session import ship_package
    ship_package(df.sparkSession)
    present = [c for c in signals if c in df.columns]
    extra = [StructField(f"{c}_{n}_{s}", DoubleType()) for c in present for n in windows for s in ("mean", "std")]
    schema = StructType(df.schema.fields + extra)
    return df.groupBy(*spec.partition).applyInPandas(_rolling_kernel(present, windows, spec.order), schema)


# --------------------------------------------------------------- alarm ---
def add_alarm_features(df: DataFrame, spec: OrderSpec = PLAIN,
                       carry_col: str | None = None) -> DataFrame:
    """FN4, WN3, WN4: alarm flag, 24/168-row alarm counts, hours since last alarm.

    ``carry_col`` names a column holding the latest alarm time *before* the
    current window partition (chunked plans); NULL/absent means none.
    """
    if "inv_alarm_code" not in df.columns:
        return df.select("*", F.lit(0).alias("alarm_active"), F.lit(0.0).alias("alarm_count_24h"),
                         F.lit(0.0).alias("alarm_count_7d"),
                         F.lit(NO_ALARM_HOURS).alias("hours_since_last_alarm"))
    active = kpi.alarm_active(F.col("inv_alarm_code"))
    # alarm times rise with the row order, so "last alarm at or before" = running max
    # (a growing frame: Spark updates it incrementally, O(rows))
    last_alarm = F.max(F.when(active == 1, F.col("datetime"))).over(
        spec.window().rowsBetween(Window.unboundedPreceding, 0))
    if carry_col:
        last_alarm = F.coalesce(last_alarm, F.col(carry_col))
    flagged = df.select("*", active.alias("alarm_active"))
    staged = flagged.select("*", running_sum(F.col("alarm_active"), spec).alias("_alarm_run"),
                            last_alarm.alias("_last_alarm"))
    out = staged.select(
        *[c for c in df.columns], "alarm_active",
        trailing_count(F.col("_alarm_run"), 24, spec).cast("double").alias("alarm_count_24h"),
        trailing_count(F.col("_alarm_run"), 168, spec).cast("double").alias("alarm_count_7d"),
        F.coalesce(hours_between(F.col("datetime"), F.col("_last_alarm")),
                   F.lit(NO_ALARM_HOURS)).alias("hours_since_last_alarm"),
    )
    return out


def running_sum(flag: Column, spec: OrderSpec) -> Column:
    """Prefix sum of an integer column (growing frame, O(rows))."""
    return F.sum(flag).over(spec.window().rowsBetween(Window.unboundedPreceding, 0))


def trailing_count(run: Column, w: int, spec: OrderSpec) -> Column:
    """Sum of the last ``w`` rows from a prefix-sum column: S(i) - S(i-w). Exact for integers."""
    return run - F.lag(run, w, 0).over(spec.window())


def forward_count(run: Column, n: int, spec: OrderSpec) -> Column:
    """Sum of rows i .. i+n-1 from a prefix-sum column: S(i+n-1) - S(i-1)."""
    w = spec.window()
    last = F.max(run).over(Window.partitionBy(*spec.partition))
    return F.coalesce(F.lead(run, n - 1).over(w), last) - F.lag(run, 1, 0).over(w)


# ----------------------------------------------------------------- KPI ---
def add_kpi_features(df: DataFrame) -> DataFrame:
    """FN5-FN9. A KPI whose input column is absent is the constant fallback."""
    cols = set(df.columns)
    power = F.col("inv_power") if "inv_power" in cols else F.lit(None).cast("double")
    out = []
    if {"meter_v_r", "meter_v_y", "meter_v_b"} <= cols:
        out.append(kpi.voltage_imbalance(F.col("meter_v_r"), F.col("meter_v_y"), F.col("meter_v_b")))
    else:
        out.append(F.lit(0.0))
    out.append(kpi.pf_deviation(F.col("meter_pf")) if "meter_pf" in cols else F.lit(0.0))
    out.append(kpi.freq_deviation(F.col("meter_freq")) if "meter_freq" in cols else F.lit(0.0))
    out.append(kpi.power_ratio(power, F.col("inv_power_24h_mean"))
               if "inv_power_24h_mean" in cols else F.lit(1.0))
    out.append(kpi.zero_fraction(F.col("smu_num_zero"), F.col("smu_total_strings"))
               if {"smu_num_zero", "smu_total_strings"} <= cols else F.lit(0.0))
    names = ["voltage_imbalance", "pf_deviation", "freq_deviation", "power_ratio_vs_24h", "smu_zero_fraction"]
    return df.select("*", *[c.alias(n) for c, n in zip(out, names)])


# -------------------------------------------------------------- labels ---
def event_columns(df: DataFrame, mean24: str = "inv_power_24h_mean") -> tuple[Column, Column]:
    cols = set(df.columns)
    power = F.col("inv_power") if "inv_power" in cols else F.lit(None).cast("double")
    alarm = F.col("inv_alarm_code") if "inv_alarm_code" in cols else F.lit(None).cast("double")
    day = F.col("is_daytime") if "is_daytime" in cols else F.lit(0)
    shutdown = kpi.shutdown_event(alarm, power, day)
    degradation = (kpi.degradation_event(power, F.col(mean24)) if mean24 in cols else F.lit(0))
    return shutdown, degradation


def add_events(df: DataFrame, mean24: str = "inv_power_24h_mean") -> DataFrame:
    """FN10, FN11 as columns ``shutdown_event`` / ``degradation_event``."""
    shutdown, degradation = event_columns(df, mean24)
    return df.select("*", shutdown.alias("shutdown_event"), degradation.alias("degradation_event"))


def forward_any(c: str, n_rows: int, spec: OrderSpec = PLAIN) -> Column:
    """WN5 (frame form): 1 if the flag is set in the current row or any of the next n-1 rows."""
    return F.max(c).over(spec.rows(0, n_rows - 1))


def add_targets(df: DataFrame, window_days: int = 7, spec: OrderSpec = PLAIN,
                keep_events: bool = False, mean24: str = "inv_power_24h_mean") -> DataFrame:
    """FN12 + WN5: forward-looking binary and 3-class targets.

    Events ahead are counted from prefix sums (lead minus lag, O(rows)) rather
    than by re-scanning a 168-row frame for every row.
    """
    n = window_days * 24
    ev = add_events(df, mean24)
    runs = ev.select("*", running_sum(F.col("shutdown_event"), spec).alias("_s_run"),
                     running_sum(F.col("degradation_event"), spec).alias("_d_run"))
    ahead = runs.select("*", forward_count(F.col("_s_run"), n, spec).alias("_s_ahead"),
                        forward_count(F.col("_d_run"), n, spec).alias("_d_ahead"))
    out = ahead.select(*ev.columns,
                       kpi.target_binary(F.col("_s_ahead"), F.col("_d_ahead")).alias("target_binary"),
                       kpi.target_multiclass(F.col("_s_ahead"), F.col("_d_ahead")).alias("target_multiclass"))
    return out if keep_events else out.drop("shutdown_event", "degradation_event")
