"""The updated store equals a rebuild, and only the chunks around the new rows are written."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetrisk.operators.hourly import aggregate_hourly
from fleetrisk.plans import incremental as inc
from fleetrisk.plans.featurize import featurize

KIND = "inverter_id string, plant_id string, datetime timestamp_ntz, inv_power double, inv_temp double, inv_alarm_code double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for e, step, days in (("p_a", 1, 60), ("p_b", 9, 60), ("q_c", 1, 20), ("q_new", 1, 2)):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(days=60 - days)
        while t < dt.datetime(2024, 3, 1):
            out.append((e, e[0], t, rng.choice([None, 0.0, rng.uniform(50, 900)]), rng.uniform(10, 50), float(rng.random() < (0.004 if e != "q_c" else 0))))
            t += dt.timedelta(hours=step)
    return out


def check(spark, root, rows, days):
    got = inc.read(spark, root)
    want = featurize(aggregate_hourly(spark.createDataFrame(rows, KIND)), days)
    cols = want.columns
    a, b = (sorted(map(tuple, d.select("inverter_id", "datetime", *cols).collect()), key=lambda r: (r[0], r[1])) for d in (got, want))
    assert [r[:2] for r in a] == [r[:2] for r in b]
    for x, y in zip(a, b):
        for c, u, v in zip(["inverter_id", "datetime", *cols], x, y):
            assert u == v or (u is not None and v is not None and (u != u and v != v or abs(u - v) < 1e-6 * max(1, abs(v)))), (x[:2], c, u, v)
    hours = inc.read(spark, root, "hourly")
    assert hours.count() == len(a) and inc.read(spark, root, "counts").agg(F.sum("n")).first()[0] == len(a)


def test_appended_days_touch_the_last_chunks(spark, rows, tmp_path):
    root, days = str(tmp_path / "store"), 2
    cut = dt.datetime(2024, 2, 27, 5)
    df = lambda rs: spark.createDataFrame(rs, KIND)
    old = [r for r in rows if r[2] < cut]
    with pytest.raises(ValueError):
        inc.update(spark, root, df(old))
    first = inc.create(spark, root, df(old), days, unit="day")
    assert inc.update(spark, root, df(old).limit(0)).version == 1
    day = [r for r in rows if cut <= r[2] < cut + dt.timedelta(days=1)]
    second = inc.update(spark, root, df(day))
    check(spark, root, old + day, days)
    changed = {c for c, v in second.chunks.items() if v == 2}
    # labels look 47 rows ahead: two days of an hourly inverter, 18 days of the one with a row in nine hours
    assert changed and min(changed) >= "t2024-02-09" and {c for c in first.chunks if c < "t2024-02-09"} <= {c for c, v in second.chunks.items() if v == 1}
    # later again, with an hour sent anew, one in the middle, and an inverter that wasn't there
    again = [r for r in rows if r[2] >= cut + dt.timedelta(days=1)]
    better = [(*old[-1][:3], 333.0, 20.0, 0.0), ("p_b", "p", dt.datetime(2024, 2, 20, 2), 100.0, 20.0, 1.0), ("r_x", "r", cut, 5.0, 5.0, 0.0)]
    third = inc.update(spark, root, df(again + better))
    keep = {r[:1] + r[2:3]: r for r in old + day}
    keep.update({r[:1] + r[2:3]: r for r in again + better})
    check(spark, root, list(keep.values()), days)
    assert third.version == 3
    with pytest.raises(RuntimeError, match="another writer"):
        inc._commit(spark, root, third)
