"""Registered queries: loading, hourly aggregation, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import add_events, add_kpi_features, add_time_features
from ..operators.hourly import aggregate_hourly
from ..schema import ROLLING_COLS, WINDOWS
from ..sources.events_fixture import load_readings
from . import sql_twins as S
from .catalog import r6, register, rounded, sql_round6
from .featurize import featured_from_events, hourly_from_events, labels_from_events

KEYS = ["inverter_id", "datetime"]
MEAN_COLS = [f"{c}_{w}_mean" for c in ROLLING_COLS for w in WINDOWS]
STD_COLS = [f"{c}_{w}_std" for c in ROLLING_COLS for w in WINDOWS]
KPI_COLS = ["voltage_imbalance", "pf_deviation", "freq_deviation", "power_ratio_vs_24h", "smu_zero_fraction"]
HOURLY_COLS = KEYS + S.HOURLY_SIGNALS + ["plant_id", "logger_mac", "inverter_idx"]


def _sel(base: str, cols: str, frm: str) -> str:
    return f"{base}\nSELECT {cols} FROM {frm}"


# ------------------------------------------------------------ hourly ---
@register("hourly_agg", _sel(S.BASE_HOURLY,
                             "inverter_id, datetime, " + r6(S.HOURLY_SIGNALS) + ", plant_id, logger_mac, inverter_idx",
                             "hourly"))
def q_hourly_agg(spark, sf):
    """AG1-AG3 + JN1: rule-driven hourly aggregation with metadata."""
    return rounded(hourly_from_events(spark, sf).select(*HOURLY_COLS))


@register("metadata_reattach", _sel(S.BASE_HOURLY, "inverter_id, datetime, plant_id, logger_mac, inverter_idx",
                                    "hourly"))
def q_metadata(spark, sf):
    """JN1: each inverter's first non-null metadata on all its hourly rows."""
    hourly = aggregate_hourly(load_readings(spark, sf), metadata="first")
    return hourly.select(*KEYS, "plant_id", "logger_mac", "inverter_idx")


@register("composed_key", _sel(S.with_stages(S.READINGS),
                               "DISTINCT plant_id, logger_mac, inverter_idx, inverter_id", "readings"))
def q_composed_key(spark, sf):
    """PRJ6: plant_mac_INVi keys and their parts."""
    return load_readings(spark, sf).select("plant_id", "logger_mac", "inverter_idx", "inverter_id").distinct()


@register("smu_row_stats", _sel(S.with_stages(S.READINGS, S.SMU),
                                "event_id, " + r6(["smu_string_mean", "smu_string_std", "smu_num_zero",
                                                   "smu_total_strings"]), "raw"))
def q_smu_row_stats(spark, sf):
    """PRJ5: per-reading string mean, sample std, zero count, string total."""
    return rounded(load_readings(spark, sf, with_strings=True).select(
        "event_id", "smu_string_mean", "smu_string_std", "smu_num_zero", "smu_total_strings"))


@register("load_summary", _sel(S.BASE_HOURLY,
                               "count(*) AS n_rows, count(DISTINCT inverter_id) AS n_inverters, "
                               "min(datetime) AS first_reading, max(datetime) AS last_reading", "hourly"))
def q_load_summary(spark, sf):
    """AG5: rows, distinct inverters, time range of the hourly table."""
    return hourly_from_events(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("inverter_id").alias("n_inverters"),
        F.min("datetime").alias("first_reading"), F.max("datetime").alias("last_reading"))


@register("raw_summary", _sel(S.with_stages(S.READINGS),
                              "count(*) AS n_rows, count(DISTINCT inverter_id) AS n_inverters, "
                              "min(datetime) AS first_reading, max(datetime) AS last_reading", "readings"))
def q_raw_summary(spark, sf):
    """SRC12 + AG5: raw (un-aggregated) readings summary."""
    return load_readings(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("inverter_id").alias("n_inverters"),
        F.min("datetime").alias("first_reading"), F.max("datetime").alias("last_reading"))


# ---------------------------------------------------------- features ---
FEATURED = S.base_featured(7)


@register("time_features", _sel(S.BASE_HOURLY,
                                "inverter_id, datetime, CAST(hour(datetime) AS INTEGER) AS hour, "
                                "CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week, "
                                "CAST(month(datetime) AS INTEGER) AS month, "
                                "CASE WHEN hour(datetime) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS is_daytime",
                                "hourly"))
def q_time_features(spark, sf):
    """FN1-FN3."""
    return add_time_features(hourly_from_events(spark, sf).select(*KEYS)) \
        .select(*KEYS, "hour", "day_of_week", "month", "is_daytime")


@register("rolling_mean", _sel(FEATURED, "inverter_id, datetime, " + r6(MEAN_COLS), "featured"))
def q_rolling_mean(spark, sf):
    """WN1: trailing means over 6/24/168 rows with min_periods."""
    return rounded(featured_from_events(spark, sf).select(*KEYS, *MEAN_COLS))


@register("rolling_std", _sel(FEATURED, "inverter_id, datetime, " + r6(STD_COLS), "featured"))
def q_rolling_std(spark, sf):
    """WN2: trailing sample std over 6/24/168 rows."""
    return rounded(featured_from_events(spark, sf).select(*KEYS, *STD_COLS))


@register("alarm_counts", _sel(FEATURED, "inverter_id, datetime, alarm_active, alarm_count_24h, alarm_count_7d",
                               "featured"))
def q_alarm_counts(spark, sf):
    """FN4 + WN3."""
    return labels_from_events(spark, sf).select(*KEYS, "alarm_active", "alarm_count_24h", "alarm_count_7d")


@register("hours_since_alarm", _sel(FEATURED, "inverter_id, datetime, " + r6(["hours_since_last_alarm"]),
                                    "featured"))
def q_hours_since_alarm(spark, sf):
    """WN4 / JN3: backward as-of to the last alarm, 9999 before any."""
    return rounded(labels_from_events(spark, sf).select(*KEYS, "hours_since_last_alarm"))


def _kpi_query(col: str):
    def build(spark, sf):
        h = add_kpi_features(hourly_from_events(spark, sf))
        return rounded(h.select(*KEYS, col))
    return build


for _c in ["voltage_imbalance", "pf_deviation", "freq_deviation"]:
    register(_c, _sel(FEATURED, f"inverter_id, datetime, {r6([_c])}", "featured"))(_kpi_query(_c))
register("smu_zero_fraction", _sel(FEATURED, "inverter_id, datetime, " + r6(["smu_zero_fraction"]),
                                   "featured"))(_kpi_query("smu_zero_fraction"))


@register("power_ratio", _sel(FEATURED, "inverter_id, datetime, " + r6(["power_ratio_vs_24h"]), "featured"))
def q_power_ratio(spark, sf):
    """FN8: power against its 24-row trailing mean."""
    return rounded(labels_from_events(spark, sf).select(*KEYS, "power_ratio_vs_24h"))


@register("shutdown_event", _sel(FEATURED, "inverter_id, datetime, shutdown_event", "feat2"))
def q_shutdown_event(spark, sf):
    """FN10: alarm or daytime zero power (missing power = zero)."""
    return add_events(labels_from_events(spark, sf)).select(*KEYS, "shutdown_event")


@register("degradation_event", _sel(FEATURED, "inverter_id, datetime, degradation_event", "feat2"))
def q_degradation_event(spark, sf):
    """FN11: production below half a 24h mean above 100."""
    return add_events(labels_from_events(spark, sf)).select(*KEYS, "degradation_event")


@register("forward_labels", _sel(FEATURED, "inverter_id, datetime, target_binary, target_multiclass", "featured"))
def q_forward_labels(spark, sf):
    """WN5 + FN12: 7-day (168-row) forward targets."""
    return labels_from_events(spark, sf).select(*KEYS, "target_binary", "target_multiclass")


@register("forward_labels_1d", _sel(S.base_featured(1), "inverter_id, datetime, target_binary, target_multiclass",
                                    "featured"))
def q_forward_labels_1d(spark, sf):
    """WN5 + FN12 with a 1-day (24-row) horizon."""
    return labels_from_events(spark, sf, window_days=1).select(*KEYS, "target_binary", "target_multiclass")


FEATURED_COLS = (HOURLY_COLS + ["hour", "day_of_week", "month", "is_daytime"]
                 + [f"{c}_{w}_{s}" for c in ROLLING_COLS for w in WINDOWS for s in ("mean", "std")]
                 + ["alarm_active", "alarm_count_24h", "alarm_count_7d", "hours_since_last_alarm"]
                 + KPI_COLS + ["target_binary", "target_multiclass"])
_FEATURED_DOUBLES = [c for c in FEATURED_COLS if c not in
                     {"inverter_id", "datetime", "plant_id", "logger_mac", "inverter_idx", "hour",
                      "day_of_week", "month", "is_daytime", "alarm_active", "target_binary", "target_multiclass"}]


def _featured_sql_cols() -> str:
    return ", ".join(f"{sql_round6(c)} AS {c}" if c in _FEATURED_DOUBLES else c for c in FEATURED_COLS)


@register("featured_table", _sel(FEATURED, _featured_sql_cols(), "featured"))
def q_featured_table(spark, sf):
    """Pipeline A end to end: the full featured table (88 columns), as stored (SRC6/SRC7)."""
    from .store import featured_table
    return rounded(featured_table(spark, sf).select(*FEATURED_COLS))


@register("featured_incremental", _sel(FEATURED, _featured_sql_cols(), "featured"))
def q_featured_incremental(spark, sf):
    """SRC6/SRC7 kept up to date: a store of the first nine tenths of the time, updated with the rest, equals the table built at once."""
    import uuid

    from ..session import scratch_path
    from . import incremental
    readings = load_readings(spark, sf)
    first, last = readings.agg(F.min("datetime"), F.max("datetime")).first()
    new = F.col("datetime") >= F.lit((first + (last - first) * 0.9).replace(minute=0, second=0, microsecond=0))  # whole hours
    root = scratch_path(spark, f"incremental/{uuid.uuid4().hex}")
    incremental.create(spark, root, readings.where(~new))
    incremental.update(spark, root, readings.where(new))
    return rounded(incremental.read(spark, root).select(*FEATURED_COLS))


@register("target_distribution", _sel(FEATURED,
                                      "'binary' AS target, target_binary AS class, count(*) AS n FROM featured "
                                      "GROUP BY 1, 2 UNION ALL SELECT 'multiclass', target_multiclass, count(*)",
                                      "featured GROUP BY 1, 2"))
def q_target_distribution(spark, sf):
    """AG4: class counts of both targets."""
    f = labels_from_events(spark, sf)
    # one pass over the table: both targets unpivoted, then one aggregate
    both = f.select(F.expr("stack(2, 'binary', target_binary, 'multiclass', target_multiclass) AS (target, class)"))
    return both.groupBy("target", "class").agg(F.count(F.lit(1)).alias("n"))
