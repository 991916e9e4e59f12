"""Keyed streaming state equals the batch operators on a replay, also over restarts, late rows and silent inverters."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from fleetrisk.operators.features import PLAIN, add_alarm_features, add_rolling_features, add_targets, add_time_features
from fleetrisk.schema import ROLLING_COLS
from fleetrisk.streaming import feature_stream as fs

T0 = dt.datetime(2024, 1, 1)
KIND = "inverter_id string, datetime timestamp_ntz, inv_power double, inv_temp double, inv_alarm_code double"


@pytest.fixture(scope="module")
def hourly(spark):
    rng = random.Random(3)
    rows = []
    for e, n in (("a", 420), ("b", 200), ("c", 30)):
        at = T0
        for _ in range(n):
            at += dt.timedelta(hours=rng.choice([1, 1, 1, 1, 2, 7]))
            rows.append((e, at, rng.choice([None, 0.0, rng.uniform(0, 900), 400.0]), rng.uniform(10, 60) if e != "b" else None, float(rng.random() < 0.02)))
    return sorted(rows, key=lambda r: r[1])


def replay(spark, parts, build, tmp_path, mode, kind=KIND):
    """Run the stream over ``parts`` (lists of files, each a list of rows); the query is stopped and started again between them."""
    src, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    spark.createDataFrame([], kind).write.parquet(src)
    for files in parts:
        for rows in files:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
        w = build(stream).writeStream.outputMode(mode).option("checkpointLocation", ckpt)
        w = w.foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("append").parquet(out))
        q = w.trigger(availableNow=True).start()
        assert q.awaitTermination(120), q.status
    return spark.read.parquet(out)


def cut(rows, *sizes):
    out, at = [], 0
    for n in sizes:
        out.append(rows[at:at + n])
        at += n
    return [p for p in [*out, rows[at:]] if p]


def same(a, b):
    if a is None or b is None or isinstance(a, (str, dt.datetime)):
        return a == b
    return (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-6 * max(1, abs(a))


def rows_by_key(df, cols):
    got = {}
    for r in df.select("inverter_id", "datetime", *cols).collect():
        assert (r.inverter_id, r.datetime) not in got
        got[r.inverter_id, r.datetime] = [None if isinstance(v, float) and math.isnan(v) else v for v in r[2:]]
    return got


def check_features(spark, got, rows):
    df = spark.createDataFrame(rows, KIND)
    want = add_alarm_features(add_rolling_features(df, PLAIN, "window"), PLAIN)
    cols = [c for c in want.columns if c not in ("inverter_id", "datetime")]
    assert any(c.startswith(ROLLING_COLS[0]) for c in cols)
    want = rows_by_key(want, cols)
    got = rows_by_key(got, cols)
    for k in got:
        assert all(same(x, y) for x, y in zip(got[k], want[k])), (k, [(c, x, y) for c, x, y in zip(cols, got[k], want[k]) if not same(x, y)])
    return set(got), set(want)


def test_features_equal_batch_over_a_restart(spark, hourly, tmp_path):
    files = cut(hourly, 100, 7, 200)
    got = replay(spark, [files[:2], files[2:]], fs.feature_stream, tmp_path, "append")
    have, want = check_features(spark, got, hourly)
    assert have == want


def test_features_start_from_a_stored_table(spark, hourly, tmp_path):
    old, new = hourly[:450], hourly[450:]
    start = fs.history(spark.createDataFrame(old, KIND))
    assert start.groupBy("inverter_id").count().agg(F.max("count")).first()[0] <= 167
    got = replay(spark, [[new[:80], new[80:]]], lambda s: fs.feature_stream(s, start), tmp_path, "append")
    have, _ = check_features(spark, got, hourly)
    assert have == {(r[0], r[1]) for r in new}


def test_rows_that_are_not_later_are_left_out(spark, hourly, tmp_path):
    rows = [r for r in hourly if r[0] == "c"]
    late = [rows[3], rows[10]]
    got = replay(spark, [[rows[:12], late + rows[12:]]], fs.feature_stream, tmp_path, "append")
    have, want = check_features(spark, got, rows)
    assert have == want


def test_state_with_an_expiry(spark, hourly, tmp_path):
    """With an expiry batches go on by the clock, so the query is stopped once its rows are there."""
    rows = [r for r in hourly if r[0] == "c"]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = fs.feature_stream(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), ttl_hours=1000)
    q = (stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt"))
         .foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).start())
    until = time.time() + 60
    while time.time() < until and not (q.lastProgress and q.lastProgress["batchId"] > 0):
        time.sleep(1)
    q.stop()
    have, want = check_features(spark, spark.read.parquet(str(tmp_path / "out")), rows)
    assert have == want


EVENTS = "inverter_id string, datetime timestamp_ntz, shutdown_event int, degradation_event int"


def labels_of(spark, hourly, days):
    df = add_rolling_features(add_time_features(spark.createDataFrame(hourly, KIND)), PLAIN, "window")
    # rarer events than those of the rows, so that all three classes occur
    df = df.withColumn("inv_alarm_code", F.when(F.pmod(F.xxhash64("datetime"), F.lit(97)) == 0, 1.0).otherwise(0.0)).withColumn("inv_power", F.greatest(F.col("inv_power"), F.lit(1.0)))
    return add_targets(df, days, PLAIN, keep_events=True).withColumn("inv_power", F.coalesce("inv_power", F.lit(1.0)))


def last_revision(df):
    out = {}
    for r in df.collect():
        k = (r.inverter_id, r.datetime)
        if k not in out or r.revision > out[k].revision:
            out[k] = r
    return out


@pytest.mark.parametrize("days", [1, 7])
def test_labels_equal_batch_with_late_rows_and_silence(spark, hourly, tmp_path, days):
    n = days * 24
    want = {(r.inverter_id, r.datetime): r for r in labels_of(spark, hourly, days).collect()}
    rows = [(r.inverter_id, r.datetime, r.shutdown_event, r.degradation_event) for r in want.values()]
    rows.sort(key=lambda r: r[1])
    rng = random.Random(1)
    # some rows come late by up to 100 hours
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.choice([0] * 12 + [rng.uniform(1, 100)])))
    quiet = ("zz", T0 + dt.timedelta(days=400), 0, 0)  # moves the watermark past everyone's last row
    files = [*cut(order, 150, 150, 2, 160), [quiet], [("zz", quiet[1] + dt.timedelta(hours=1), 0, 0)]]
    got = replay(spark, [files[:2], files[2:]], lambda s: fs.label_stream(s, days, watermark="200 hours"), tmp_path, "update", EVENTS)
    last = last_revision(got.where("inverter_id <> 'zz'"))
    assert set(last) == set(want)
    by = {}
    for e, at in sorted(want):
        by.setdefault(e, []).append(at)
    for (e, at), r in last.items():
        assert (r.target_binary, r.target_multiclass) == (want[e, at].target_binary, want[e, at].target_multiclass), (e, at)
        assert r.complete == (by[e].index(at) + n <= len(by[e]))
    assert len({r.target_multiclass for r in last.values()}) >= 2


def test_a_late_event_revises_labels(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(hours=i), int(i == 30), 0) for i in range(60)]
    got = replay(spark, [[rows[:30] + rows[31:]], [rows[30:31]]], lambda s: fs.label_stream(s, 1), tmp_path, "update", EVENTS).collect()
    first = {r.datetime.day * 24 + r.datetime.hour - 24: r for r in got if r.revision == 1}
    again = {r.datetime.day * 24 + r.datetime.hour - 24: r for r in got if r.revision == 2}
    assert set(again) == set(range(7, 30)) and all((r.target_binary, r.target_multiclass) == (1, 2) for r in again.values())
    assert all((first[i].target_binary, first[i].complete) == (0, True) for i in range(30)) and first[30].target_multiclass == 2 and max(r.revision for r in got) == 2
