"""Sparse-reading completion for scoring (SV1-SV8): the serving-side feature rules.

These rules deliberately differ from the training features (the reference
keeps train/serve skew); they are a separate operator set. Input: readings
with ``features map<string,double>`` and an ``as_of`` timestamp; the baseline
is a small (feature, median) table (one row per model feature) that enters
the plan as a literal map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY_FEATURES, NO_ALARM_HOURS, NOMINAL_FREQ


def _given(k: str) -> Column:
    return F.map_contains_key(F.col("features"), k)


def _in(k: str) -> Column:
    return F.col("features")[k]


def complete_readings(readings: DataFrame, baseline: DataFrame | None,
                      model_features: Sequence[str] = KEY_FEATURES, defaults: str = "baseline",
                      keep: Sequence[str] = ("reading_id", "inverter_id")) -> DataFrame:
    """Dense model rows from sparse readings.

    ``defaults='baseline'``: SV1-SV7 (overlay on healthy medians, derived KPI
    rules). ``defaults='zero'``: SV8 manual entry (unspecified -> 0.0, no rules).
    """
    feats = list(model_features)
    if defaults == "zero":
        return readings.select(*keep, *[F.coalesce(_in(f), F.lit(0.0)).alias(f) for f in feats])
    # the baseline has one row per feature: it enters the plan as a literal map
    pairs = [(r["feature"], r["median"]) for r in baseline.collect()] if baseline is not None else []
    lit_map = (F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v).cast("double"))])
               if pairs else F.create_map()).cast("map<string,double>")
    d = readings.withColumn("baseline", lit_map)
    base = F.col("baseline")

    # SV1: baseline, else 0.0; supplied values of known features override
    row = {f: F.coalesce(_in(f), base[f], F.lit(0.0)) for f in feats}
    # SV2: clock features from as_of unless supplied; daytime always recomputed
    if "hour" in row:
        row["hour"] = F.when(_given("hour"), _in("hour")).otherwise(F.hour("as_of").cast("double"))
    if "month" in row:
        row["month"] = F.when(_given("month"), _in("month")).otherwise(F.month("as_of").cast("double"))
    hour = row.get("hour", F.lit(0.0))
    if "is_daytime" in row:
        row["is_daytime"] = F.when((hour >= 6) & (hour <= 18), F.lit(1.0)).otherwise(F.lit(0.0))
    # SV3: alarm rules keyed on a supplied 7-day count
    a = _in("alarm_count_7d")
    if "alarm_count_24h" in row:
        row["alarm_count_24h"] = F.when(_given("alarm_count_7d") & ~_given("alarm_count_24h"),
                                        F.least(a, a / 7.0)).otherwise(row["alarm_count_24h"])
    if "hours_since_last_alarm" in row:
        row["hours_since_last_alarm"] = (
            F.when(_given("alarm_count_7d") & (a > 0), F.greatest(F.lit(1.0), F.lit(168.0) / (a + 1)))
            .when(_given("alarm_count_7d"), F.lit(NO_ALARM_HOURS))
            .otherwise(row["hours_since_last_alarm"]))
    # SV4: (max - min) / mean of the three phases (mean <= 0 -> divisor 1)
    if {"meter_v_r", "meter_v_y", "meter_v_b", "voltage_imbalance"} <= set(row):
        vr, vy, vb = row["meter_v_r"], row["meter_v_y"], row["meter_v_b"]
        mean = (vr + vy + vb) / 3.0
        div = F.when(mean > 0, mean).otherwise(F.lit(1.0))
        row["voltage_imbalance"] = (F.greatest(vr, vy, vb) - F.least(vr, vy, vb)) / div
    # SV5: deviations from the completed values (no inner abs on pf)
    if "meter_pf" in row and "pf_deviation" in row:
        row["pf_deviation"] = F.abs(F.lit(1.0) - row["meter_pf"])
    if "meter_freq" in row and "freq_deviation" in row:
        row["freq_deviation"] = F.abs(row["meter_freq"] - F.lit(NOMINAL_FREQ))
    # SV6: power ratio estimated from the baseline power when not supplied
    if "power_ratio_vs_24h" in row:
        bp = F.coalesce(base["inv_power"], F.lit(1.0))
        row["power_ratio_vs_24h"] = F.when(_given("inv_power") & ~_given("power_ratio_vs_24h"),
                                           _in("inv_power") / (bp + 0.01)).otherwise(row["power_ratio_vs_24h"])
    # SV7: zero fraction when the string total is positive
    if {"smu_total_strings", "smu_zero_fraction"} <= set(row):
        tot = row["smu_total_strings"]
        zero = row.get("smu_num_zero", F.lit(0.0))
        row["smu_zero_fraction"] = F.when(tot > 0, zero / tot).otherwise(row["smu_zero_fraction"])
    return d.select(*keep, *[row[f].alias(f) for f in feats])


def readings_from_featured(featured: DataFrame) -> DataFrame:
    """Sparse readings derived from a featured table (test source for SV*).

    Which keys a reading carries depends on the row: power and alarm keys on
    alternating inverters, clock keys at night only, so every rule branch runs.
    """
    idx = F.col("inverter_idx")
    always = ["inv_temp", "meter_pf", "meter_freq", "meter_v_r", "meter_v_y", "meter_v_b",
              "smu_num_zero", "smu_total_strings", "ambient_temp"]
    entries = [F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in always]
    entries.append(F.when(idx % 2 == 0, F.struct(F.lit("inv_power").alias("key"), F.col("inv_power").alias("value"))))
    entries.append(F.when(idx % 3 == 0, F.struct(F.lit("alarm_count_7d").alias("key"),
                                                 F.col("alarm_count_7d").alias("value"))))
    entries.append(F.when(idx % 5 == 0, F.struct(F.lit("alarm_count_24h").alias("key"),
                                                 F.col("alarm_count_24h").alias("value"))))
    entries.append(F.when(F.col("is_daytime") == 0, F.struct(F.lit("hour").alias("key"),
                                                             F.col("hour").cast("double").alias("value"))))
    entries.append(F.when(idx % 4 == 1, F.struct(F.lit("unknown_sensor").alias("key"), F.lit(1.0).alias("value"))))
    kv = F.filter(F.array_compact(F.array(*entries)), lambda e: e["value"].isNotNull())
    rid = F.concat_ws("|", F.col("inverter_id"), F.date_format("datetime", "yyyy-MM-dd HH"))
    return featured.select(rid.alias("reading_id"), "inverter_id",
                           F.map_from_entries(kv).alias("features"), F.col("datetime").alias("as_of"))
