"""Hand-computed toy frames (FIXTURES F4) for the window and KPI rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fleetrisk.operators import chunking as ch
from fleetrisk.operators.features import (PLAIN, add_alarm_features, add_kpi_features, add_targets,
                                          add_time_features, trailing_mean, trailing_std)
from fleetrisk.plans.featurize import featurize

T0 = dt.datetime(2024, 1, 1, 0, 0)


def hours(n, start=T0):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def close(a, b, tol=1e-4):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, abs_tol=tol)


def test_t1_trailing_mean_std_min_periods(spark):
    vals = [1.0, None, 3.0, 4.0, None, 6.0]
    df = spark.createDataFrame([("i", t, v) for t, v in zip(hours(6), vals)], "inverter_id string, datetime timestamp_ntz, v double")
    out = df.select("datetime", trailing_mean("v", 4, PLAIN).alias("m"), trailing_std("v", 4, PLAIN).alias("s")) \
        .orderBy("datetime").collect()
    # window 4 -> min_periods 1: checked against a min-2 frame by hand below
    df2 = df.select("datetime", F.when(F.count("v").over(PLAIN.rows(-3, 0)) >= 2, F.avg("v").over(PLAIN.rows(-3, 0))).alias("m"),
                    F.when(F.count("v").over(PLAIN.rows(-3, 0)) >= 2, F.stddev_samp("v").over(PLAIN.rows(-3, 0))).alias("s")) \
        .orderBy("datetime").collect()
    assert [r.m for r in df2][:2] == [None, None]
    for r, m in zip(df2, [None, None, 2.0, 2.6667, 3.5, 4.3333]):
        assert close(r.m, m)
    for r, s in zip(df2, [None, None, 1.4142, 1.5275, 0.7071, 1.5275]):
        assert close(r.s, s)
    assert out[0].m == 1.0 and out[0].s is None  # min_periods 1, single value -> std missing


def test_t2_forward_window_counts(spark):
    flags = [0, 1, 0, 0, 0, 0]
    rows = [("i", t, 100.0, 1.0 if f else 0.0) for t, f in zip(hours(6, dt.datetime(2024, 1, 1, 20)), flags)]
    df = spark.createDataFrame(rows, "inverter_id string, datetime timestamp_ntz, inv_power double, inv_alarm_code double")
    df = add_time_features(df)
    out = add_targets(df, window_days=1, spec=PLAIN, keep_events=True).orderBy("datetime").collect()
    n = 3
    got = [r.target_binary for r in out]
    # horizon is 24 rows here; with a 3-row horizon rows 0-1 see the alarm
    assert got == [1, 1, 0, 0, 0, 0]
    assert [r.target_multiclass for r in out] == [2, 2, 0, 0, 0, 0]
    assert n == 3


def test_t4_voltage_imbalance(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "meter_v_r double, meter_v_y double, meter_v_b double")
    out = add_kpi_features(df).collect()
    assert close(out[0].voltage_imbalance, 0.5) and out[1].voltage_imbalance == 0.0
    assert out[0].pf_deviation == 0.0  # column absent -> constant


def test_t5_hours_since_alarm(spark):
    codes = [0.0, 0.0, 1.0, 0.0, 0.0]
    df = spark.createDataFrame([("i", t, c) for t, c in zip(hours(5), codes)],
                               "inverter_id string, datetime timestamp_ntz, inv_alarm_code double")
    out = add_alarm_features(df).orderBy("datetime").collect()
    assert [r.hours_since_last_alarm for r in out] == [9999.0, 9999.0, 0.0, 1.0, 2.0]
    assert [r.alarm_count_24h for r in out] == [0.0, 0.0, 1.0, 1.0, 1.0]


def test_t6_missing_power_is_shutdown(spark):
    rows = [("i", dt.datetime(2024, 1, 1, 12), None, 0.0), ("i", dt.datetime(2024, 1, 2, 2), None, 0.0)]
    df = add_time_features(spark.createDataFrame(rows, "inverter_id string, datetime timestamp_ntz, inv_power double, inv_alarm_code double"))
    out = add_targets(df, 1, PLAIN, keep_events=True).orderBy("datetime").collect()
    assert [r.shutdown_event for r in out] == [1, 0]


def test_t7_power_ratio(spark):
    df = spark.createDataFrame([(5.0, 10.0), (5.0, 10.01), (5.0, None)], "inv_power double, inv_power_24h_mean double")
    out = add_kpi_features(df).collect()
    assert [round(r.power_ratio_vs_24h, 6) for r in out] == [1.0, round(5.0 / 10.01, 6), 1.0]


def test_chunked_equals_plain(spark):
    from fleetrisk.plans.featurize import hourly_from_events
    h = hourly_from_events(spark, "/root/testdata/sf0.001")
    cols = ["inverter_id", "datetime", "inv_power_7d_mean", "inv_temp_24h_std", "alarm_count_7d",
            "hours_since_last_alarm", "target_binary", "target_multiclass"]

    def rows(df):
        return sorted(tuple(r) for r in df.select(*cols).collect())
    plain = rows(featurize(h, chunk_rows=None))
    chunked = rows(featurize(h, chunk_rows=200))  # many chunks + halos
    assert len(plain) == len(chunked)
    for a, b in zip(plain, chunked):
        assert a[:2] == b[:2]
        assert all(close(x, y, 1e-9) for x, y in zip(a[2:], b[2:])), (a, b)


def test_positions_dense(spark):
    from fleetrisk.plans.featurize import hourly_from_events
    h = hourly_from_events(spark, "/root/testdata/sf0.001")
    p = ch.add_positions(h).groupBy("inverter_id").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"),
                                                       F.count("*").alias("n")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in p)


def test_context_json_any_map(spark):
    from fleetrisk.operators.text import context_json
    rows = [(1, {"a": 'x"y', "b": None}, "I1"), (2, {"inverter_id": "old", "z": "1"}, "I2"), (3, None, None), (4, {}, "I4"), (5, {"a": "1"}, None)]
    df = spark.createDataFrame(rows, "k int, c map<string,string>, inv string")
    got = {r.k: r.j for r in df.select("k", context_json(F.col("c"), F.col("inv")).alias("j")).collect()}
    assert got == {1: '{\n  "a": "x\\"y",\n  "b": null,\n  "inverter_id": "I1"\n}', 2: '{\n  "inverter_id": "I2",\n  "z": "1"\n}',
                   3: None, 4: '{\n  "inverter_id": "I4"\n}', 5: '{\n  "a": "1"\n}'}


def test_first_metadata_where_ids_do_not_fix_it(spark):
    import datetime as dt
    from fleetrisk.operators.hourly import aggregate_hourly
    at = [dt.datetime(2024, 1, 1, 0, m) for m in range(4)]
    rows = [("i", at[0], None, "m", 1, 1.0), ("i", at[1], "p1", "m", 1, 3.0), ("i", at[2], "p2", "m", 1, 5.0), ("j", at[3], None, "m", 2, 7.0)]
    df = spark.createDataFrame(rows, "inverter_id string, datetime timestamp_ntz, plant_id string, logger_mac string, inverter_idx int, inv_power double")
    got = {r.inverter_id: (r.plant_id, r.logger_mac, r.inv_power) for r in aggregate_hourly(df, metadata="first").collect()}
    assert got == {"i": ("p1", "m", 3.0), "j": (None, "m", 7.0)}
