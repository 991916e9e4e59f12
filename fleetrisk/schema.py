"""Fixed names and values shared across operators.

The lists and strings below are FIXED VALUES: they must equal the behaviour
being reproduced (signal names, window sizes, model feature list, labels and
texts), so they are stated plainly and in their natural order.
"""

from __future__ import annotations

# --- FIXED VALUES: rolling windows (rows of hourly data) -------------------
WINDOWS = {"6h": 6, "24h": 24, "7d": 168}

# --- FIXED VALUES: signals with trailing statistics ------------------------
ROLLING_COLS = [
    "inv_power", "inv_temp",
    "ambient_temp", "meter_freq", "meter_pf",
    "meter_v_r", "meter_v_y", "meter_v_b",
    "smu_string_mean",
]

# --- FIXED VALUES: metadata columns of a per-inverter reading --------------
META_COLS = ["plant_id", "logger_mac", "inverter_idx", "inverter_id"]

# --- FIXED VALUES: columns never used as model features --------------------
EXCLUDE_COLS = [
    "datetime", "timestampDate", "plant_id", "logger_mac",
    "inverter_idx", "inverter_id",
    "target_binary", "target_multiclass",
    "inv_alarm_code", "inv_op_state",
    "alarm_active",
]

# --- FIXED VALUES: the 30 key telemetry features of the lightweight model --
KEY_FEATURES = [
    "inv_power", "inv_temp", "inv_freq",
    "inv_v_ab", "inv_v_bc", "inv_v_ca",
    "inv_pv1_power", "inv_kwh_today",
    "meter_pf", "meter_freq",
    "meter_v_r", "meter_v_y", "meter_v_b",
    "meter_meter_active_power",
    "ambient_temp",
    "smu_string_mean", "smu_string_std", "smu_num_zero", "smu_total_strings",
    "alarm_count_24h", "alarm_count_7d", "hours_since_last_alarm",
    "hour", "month", "is_daytime",
    "voltage_imbalance", "pf_deviation", "freq_deviation",
    "power_ratio_vs_24h", "smu_zero_fraction",
]

# --- FIXED VALUES: risk classes --------------------------------------------
RISK_LEVELS = {0: "no_risk", 1: "degradation_risk", 2: "shutdown_risk"}
RISK_DISPLAY = {0: "No Risk", 1: "Degradation Risk", 2: "Shutdown Risk"}
RISK_EMOJI = {0: "✅", 1: "⚠️", 2: "\U0001f6a8"}
RISK_RECOMMENDATIONS = {
    "no_risk": "System operating normally. Continue routine monitoring.",
    "degradation_risk": "⚠️ Performance degradation detected. Schedule inspection within 7 days. Check PV string connections and clean panels.",
    "shutdown_risk": "\U0001f6a8 High shutdown risk! Immediate inspection required. Check alarm codes, temperature readings, and grid connection stability.",
}
UNKNOWN_LEVEL = "unknown"
DEFAULT_RECOMMENDATION = "Monitor closely."

# --- FIXED VALUES: sentinels and constants ---------------------------------
NO_ALARM_HOURS = 9999.0
NOMINAL_FREQ = 50.0
DAY_START_HOUR, DAY_END_HOUR = 6, 18
