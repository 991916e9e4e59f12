"""Per-inverter telemetry readings derived from the ``events`` table.

No raw plant telemetry exists, so the test fixture maps every event to one
5-minute-style reading of one inverter (32 inverters, 3 plants, 6 loggers).
The mapping is a pure projection of the whole table: no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

N_INVERTERS = 32

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def _row_stats_sql(strings: list[str]) -> tuple[str, str, str]:
    """SQL text of the PRJ5 row statistics (mean, sample std, zero count) over ``strings``."""
    n = " + ".join(f"(CASE WHEN {s} IS NULL THEN 0 ELSE 1 END)" for s in strings)
    total = " + ".join(f"coalesce({s}, 0.0D)" for s in strings)
    mean = f"(CASE WHEN ({n}) > 0 THEN ({total}) / ({n}) END)"
    ss = " + ".join(f"coalesce(({s} - {mean}) * ({s} - {mean}), 0.0D)" for s in strings)
    std = f"(CASE WHEN ({n}) >= 2 THEN sqrt(({ss}) / (({n}) - 1)) END)"
    zeros = "CAST(" + " + ".join(f"(CASE WHEN {s} = 0 THEN 1 ELSE 0 END)" for s in strings) + " AS DOUBLE)"
    return mean, std, zeros


def readings_from_events(events: DataFrame, with_strings: bool = False) -> DataFrame:
    """F2 mapping: events -> raw per-inverter readings (one row per event).

    Output columns follow the loader's layout: ``datetime``, the common meter /
    sensor signals, the ``inv_*`` block, the SMU row statistics, then metadata.
    Written as SQL expressions: one JVM call per column when the plan is built.
    """
    strings = ["_s1", "_s2", "_s3"]
    mean, std, zeros = _row_stats_sql(strings)
    staged = events.selectExpr(
        "*", f"CAST(user_id % {N_INVERTERS} AS INT) AS _idx", "CAST(ts AS TIMESTAMP_NTZ) AS _ts",
        "CASE WHEN event_id % 3 = 0 THEN 0.0D ELSE value / 10 END AS _s1",
        "CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE value / 20 END AS _s2",
        "CASE WHEN event_id % 7 = 0 THEN 0.0D ELSE value / 30 END AS _s3")
    plant = "concat('Plant_', CAST(_idx % 3 + 1 AS STRING))"
    mac = "concat('MAC', CAST(_idx % 6 AS STRING))"
    cols = [
        "_ts AS datetime",
        "CAST(15 + event_id % 20 AS DOUBLE) AS ambient_temp",
        "49.5D + CAST(event_id % 11 AS DOUBLE) / 10.0D AS meter_freq",
        "CASE WHEN event_id % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE 0.8D + CAST(event_id % 21 AS DOUBLE) / 100.0D END AS meter_pf",
        "CAST(230 + event_id % 9 AS DOUBLE) AS meter_v_r",
        "CAST(231 + event_id % 7 AS DOUBLE) AS meter_v_y",
        "CASE WHEN event_id % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(229 + event_id % 5 AS DOUBLE) END AS meter_v_b",
        "CASE WHEN value < 0.5 THEN 0.0D ELSE value * 10 END AS inv_power",
        "CASE WHEN event_type = 'error' AND value >= 200 THEN 1.0D ELSE 0.0D END AS inv_alarm_code",
        "20.0D + CAST(event_id * 7 % 400 AS DOUBLE) / 10.0D AS inv_temp",
        "CAST(hour(_ts) * 10 AS DOUBLE) + CAST(minute(_ts) AS DOUBLE) / 6.0D AS inv_kwh_today",
        "CAST(event_id % 4 AS DOUBLE) AS inv_op_state",
        f"{mean} AS smu_string_mean", f"{std} AS smu_string_std", f"{zeros} AS smu_num_zero",
        f"{float(len(strings))}D AS smu_total_strings",
        f"{plant} AS plant_id", f"{mac} AS logger_mac", "_idx AS inverter_idx",
        f"concat({plant}, '_', {mac}, '_INV', CAST(_idx AS STRING)) AS inverter_id",
    ]
    if with_strings:
        cols += ["event_id", "_s1 AS smu_1", "_s2 AS smu_2", "_s3 AS smu_3"]
    return staged.selectExpr(*cols)


def load_readings(spark: SparkSession, sf_dir: str, with_strings: bool = False) -> DataFrame:
    return readings_from_events(read_table(spark, sf_dir, "events", EVENT_COLUMNS), with_strings)
