"""ANSI SQL twins (DuckDB dialect) of the Spark operators, for the oracle check.

These strings are the *independent* statement of each operator's semantics:
the Spark side is written with the DataFrame API, the SQL side declaratively.
Shared stages are common table expressions built here once.
"""

from __future__ import annotations

from ..schema import ROLLING_COLS, WINDOWS

# ---------------------------------------------------------------- stages ---
READINGS = """
readings AS (
  SELECT
    CAST(ts AS TIMESTAMP) AS datetime,
    CAST(15 + event_id % 20 AS DOUBLE) AS ambient_temp,
    49.5 + CAST(event_id % 11 AS DOUBLE) / 10.0 AS meter_freq,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE 0.8 + CAST(event_id % 21 AS DOUBLE) / 100.0 END AS meter_pf,
    CAST(230 + event_id % 9 AS DOUBLE) AS meter_v_r,
    CAST(231 + event_id % 7 AS DOUBLE) AS meter_v_y,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(229 + event_id % 5 AS DOUBLE) END AS meter_v_b,
    CASE WHEN value < 0.5 THEN 0.0 ELSE value * 10 END AS inv_power,
    CASE WHEN event_type = 'error' AND value >= 200 THEN 1.0 ELSE 0.0 END AS inv_alarm_code,
    20 + CAST(event_id * 7 % 400 AS DOUBLE) / 10.0 AS inv_temp,
    CAST(hour(ts) * 10 AS DOUBLE) + CAST(minute(ts) AS DOUBLE) / 6.0 AS inv_kwh_today,
    CAST(event_id % 4 AS DOUBLE) AS inv_op_state,
    s1, s2, s3,
    'Plant_' || CAST(user_id % 32 % 3 + 1 AS VARCHAR) AS plant_id,
    'MAC' || CAST(user_id % 32 % 6 AS VARCHAR) AS logger_mac,
    CAST(user_id % 32 AS INTEGER) AS inverter_idx,
    'Plant_' || CAST(user_id % 32 % 3 + 1 AS VARCHAR) || '_MAC' || CAST(user_id % 32 % 6 AS VARCHAR)
      || '_INV' || CAST(user_id % 32 AS VARCHAR) AS inverter_id,
    event_id
  FROM (
    SELECT *,
      CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value / 10 END AS s1,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 20 END AS s2,
      CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value / 30 END AS s3
    FROM events) e
)"""

SMU = """
smu AS (
  SELECT *,
    CASE WHEN n_str > 0 THEN sum_str / n_str END AS smu_string_mean
  FROM (
    SELECT *,
      (CASE WHEN s1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN s2 IS NULL THEN 0 ELSE 1 END)
        + (CASE WHEN s3 IS NULL THEN 0 ELSE 1 END) AS n_str,
      coalesce(s1, 0.0) + coalesce(s2, 0.0) + coalesce(s3, 0.0) AS sum_str
    FROM readings) r
),
raw AS (
  SELECT datetime, ambient_temp, meter_freq, meter_pf, meter_v_r, meter_v_y, meter_v_b,
    inv_power, inv_alarm_code, inv_temp, inv_kwh_today, inv_op_state,
    smu_string_mean,
    CASE WHEN n_str >= 2 THEN sqrt((coalesce((s1 - smu_string_mean) ^ 2, 0.0)
      + coalesce((s2 - smu_string_mean) ^ 2, 0.0) + coalesce((s3 - smu_string_mean) ^ 2, 0.0)) / (n_str - 1)) END
      AS smu_string_std,
    CAST((CASE WHEN s1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN s2 = 0 THEN 1 ELSE 0 END)
      + (CASE WHEN s3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS smu_num_zero,
    3.0 AS smu_total_strings,
    plant_id, logger_mac, inverter_idx, inverter_id, event_id
  FROM smu
)"""

HOURLY_SIGNALS = ["ambient_temp", "meter_freq", "meter_pf", "meter_v_r", "meter_v_y", "meter_v_b",
                  "inv_power", "inv_alarm_code", "inv_temp", "inv_kwh_today", "inv_op_state",
                  "smu_string_mean", "smu_string_std", "smu_num_zero", "smu_total_strings"]


def _hourly_agg(c: str) -> str:
    if "alarm" in c or "op_state" in c:
        return f"max({c}) AS {c}"
    if "kwh_today" in c or "kwh_total" in c:
        return f"arg_max({c}, datetime) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    return f"avg({c}) AS {c}"


HOURLY = """
hourly AS (
  SELECT inverter_id, date_trunc('hour', datetime) AS datetime,
    """ + ",\n    ".join(_hourly_agg(c) for c in HOURLY_SIGNALS) + """,
    first(plant_id) AS plant_id, first(logger_mac) AS logger_mac, first(inverter_idx) AS inverter_idx
  FROM raw
  WHERE inverter_id IS NOT NULL AND datetime IS NOT NULL
  GROUP BY 1, 2
)"""


def _w(a: int, b: int) -> str:
    lo = f"{a} PRECEDING" if a > 0 else "CURRENT ROW"
    hi = f"{b} FOLLOWING" if b > 0 else "CURRENT ROW"
    return f"(PARTITION BY inverter_id ORDER BY datetime ROWS BETWEEN {lo} AND {hi})"


def _rolling_sql() -> list[str]:
    out = []
    for c in ROLLING_COLS:
        for name, w in WINDOWS.items():
            m = max(1, w // 4)
            fr = _w(w - 1, 0)
            out.append(f"CASE WHEN count({c}) OVER {fr} >= {m} THEN avg({c}) OVER {fr} END AS {c}_{name}_mean")
            out.append(f"CASE WHEN count({c}) OVER {fr} >= {m} THEN stddev_samp({c}) OVER {fr} END AS {c}_{name}_std")
    return out


FEAT1 = """
feat1 AS (
  SELECT *,
    CAST(hour(datetime) AS INTEGER) AS hour,
    CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
    CAST(month(datetime) AS INTEGER) AS month,
    CASE WHEN hour(datetime) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS is_daytime,
    """ + ",\n    ".join(_rolling_sql()) + """,
    CASE WHEN coalesce(inv_alarm_code, 0) > 0 THEN 1 ELSE 0 END AS alarm_active,
    CAST(sum(CASE WHEN coalesce(inv_alarm_code, 0) > 0 THEN 1 ELSE 0 END) OVER """ + _w(23, 0) + """ AS DOUBLE) AS alarm_count_24h,
    CAST(sum(CASE WHEN coalesce(inv_alarm_code, 0) > 0 THEN 1 ELSE 0 END) OVER """ + _w(167, 0) + """ AS DOUBLE) AS alarm_count_7d,
    coalesce(epoch_us(datetime) - epoch_us(max(CASE WHEN coalesce(inv_alarm_code, 0) > 0 THEN datetime END)
      OVER (PARTITION BY inverter_id ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), NULL)
      / 3600000000.0 AS hsla_raw
  FROM hourly
)"""

FEAT2 = """
feat2 AS (
  SELECT * EXCLUDE (hsla_raw),
    coalesce(hsla_raw, 9999.0) AS hours_since_last_alarm,
    CASE WHEN vm > 0 THEN greatest(abs(meter_v_r - vm), abs(meter_v_y - vm), abs(meter_v_b - vm)) / vm ELSE 0.0 END
      AS voltage_imbalance,
    abs(1.0 - abs(coalesce(meter_pf, 1.0))) AS pf_deviation,
    abs(coalesce(meter_freq, 50.0) - 50.0) AS freq_deviation,
    CASE WHEN inv_power_24h_mean > 10 THEN coalesce(inv_power, 0.0) / inv_power_24h_mean ELSE 1.0 END
      AS power_ratio_vs_24h,
    coalesce(smu_num_zero, 0.0) / (CASE WHEN coalesce(smu_total_strings, 1.0) = 0 THEN 1.0
      ELSE coalesce(smu_total_strings, 1.0) END) AS smu_zero_fraction,
    CASE WHEN coalesce(inv_alarm_code, 0) > 0 OR (coalesce(inv_power, 0) = 0 AND hour(datetime) BETWEEN 6 AND 18)
      THEN 1 ELSE 0 END AS shutdown_event,
    CASE WHEN coalesce(inv_power, 0) > 0 AND coalesce(inv_power_24h_mean, 0) > 100
      AND coalesce(inv_power, 0) < coalesce(inv_power_24h_mean, 0) * 0.5 THEN 1 ELSE 0 END AS degradation_event
  FROM (
    SELECT *,
      CASE WHEN (CASE WHEN meter_v_r IS NULL THEN 0 ELSE 1 END + CASE WHEN meter_v_y IS NULL THEN 0 ELSE 1 END
        + CASE WHEN meter_v_b IS NULL THEN 0 ELSE 1 END) > 0
      THEN (coalesce(meter_v_r, 0.0) + coalesce(meter_v_y, 0.0) + coalesce(meter_v_b, 0.0))
        / (CASE WHEN meter_v_r IS NULL THEN 0 ELSE 1 END + CASE WHEN meter_v_y IS NULL THEN 0 ELSE 1 END
        + CASE WHEN meter_v_b IS NULL THEN 0 ELSE 1 END) END AS vm
    FROM feat1) f
)"""


def featured_cte(window_days: int = 7) -> str:
    n = window_days * 24
    fr = _w(0, n - 1)
    return f"""
featured AS (
  SELECT * EXCLUDE (vm, s_ahead, d_ahead),
    CASE WHEN s_ahead > 0 OR d_ahead > 0 THEN 1 ELSE 0 END AS target_binary,
    CASE WHEN s_ahead > 0 THEN 2 WHEN d_ahead > 0 THEN 1 ELSE 0 END AS target_multiclass
  FROM (
    SELECT *, max(shutdown_event) OVER {fr} AS s_ahead, max(degradation_event) OVER {fr} AS d_ahead
    FROM feat2) g
)"""


def with_stages(*stages: str) -> str:
    return "WITH " + ",".join(stages)


BASE_HOURLY = with_stages(READINGS, SMU, HOURLY)


def base_featured(window_days: int = 7) -> str:
    return with_stages(READINGS, SMU, HOURLY, FEAT1, FEAT2, featured_cte(window_days))
