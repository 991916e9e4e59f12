"""Shapley values against exact enumeration; quantile sketches against exact ranks."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetrisk.models import boost, shapley
from fleetrisk.models.gbt import BoostParams
from fleetrisk.operators import sketches

FEATS = [f"x{i}" for i in range(8)]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    y = (x[:, 0] * x[:, 1] + x[:, 2] - (x[:, 3] > 0) * x[:, 4] > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "k long, " + ", ".join(f"{f} double" for f in FEATS) + ", y int")
    return df.cache(), boost.fit(df, FEATS, "y", (0, 1), BoostParams(max_iter=6, max_depth=4, step_size=0.4))


def exact(x, margin, background):
    """Interventional Shapley values by all subsets, over all background rows."""
    d = len(x)
    worth = {}
    for r in range(d + 1):
        for s in itertools.combinations(range(d), r):
            mixed = background.copy()
            mixed[:, list(s)] = x[list(s)]
            worth[s] = margin(mixed).mean()
    out = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for r in range(d):
            weight = math.factorial(r) * math.factorial(d - r - 1) / math.factorial(d)
            for s in itertools.combinations(rest, r):
                out[i] += weight * (worth[tuple(sorted((*s, i)))] - worth[s])
    return out, worth[()]


def test_values_equal_exact_enumeration_within_the_error(spark, fitted):
    df, model = fitted
    rows = np.array([[r[f] for f in FEATS] for r in df.orderBy("k").limit(12).collect()])
    margin = lambda z: boost.raw_margins(z, model)[:, 0]
    background = shapley.background_rows(df, FEATS, ["k"], 10)
    phi, err, base = shapley.shapley_values(rows, margin, background, 400)
    for x, got, e in zip(rows, phi, err):
        want, start = exact(x, margin, background)
        assert np.all(np.abs(got - want) <= 4.5 * e + 1e-9) and abs(base - start) < 1e-9
        assert abs(got.sum() + base - margin(x[None])[0]) < 1e-9  # additive
    assert err.max() < 0.2 and shapley.shapley_values(rows, margin, background, 1600)[1].mean() < 0.6 * err.mean()


def test_frame_of_shapley_values(spark, fitted):
    df, model = fitted
    background = shapley.background_rows(df, FEATS, ["k"], 16)
    part = df.select("k", *(F.when(F.col("k") != 3, F.col(f)).alias(f) for f in FEATS)).limit(40)
    all_ = {r.k: r for r in shapley.add_shapley(part, model, background, pairs=8, k=None).collect()}
    few = {r.k: r for r in shapley.add_shapley(part.repartition(5), model, background, pairs=8, k=3).collect()}
    score = {r.k: r.m[0] for r in boost.margins(model, part, "m").collect()}
    for k, r in all_.items():
        assert abs(sum(d.impact for d in r.top_risk_factors) + r.base_value - score[k]) < 1e-9
        assert [d.feature for d in few[k].top_risk_factors] == [d.feature for d in r.top_risk_factors[:3]]  # whatever the batch
        assert [abs(d.impact) for d in r.top_risk_factors] == sorted((abs(d.impact) for d in r.top_risk_factors), reverse=True)
    assert all(d.value == 0 for d in all_[3].top_risk_factors)
    means = {r.feature: r.mean_abs_impact for r in shapley.mean_shapley(shapley.add_shapley(part, model, background, pairs=8, k=None)).collect()}
    assert means["x5"] < means["x2"] and set(means) == set(FEATS)
    assert shapley.add_shapley(part.limit(0), model, background, pairs=2).count() == 0
    with pytest.raises(ValueError, match="background"):
        shapley.background_rows(df.limit(0), FEATS, ["k"])


def test_sketches_merge_within_the_bound(spark, tmp_path):
    rng = random.Random(9)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), rng.gauss(0, 1), float(rng.randrange(3)), None if i % 3 else rng.random()) for i in range(20_000)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, a double, b double, c double").repartition(7).cache()
    feats, k = ["a", "b", "c"], 100
    path = str(tmp_path / "s")
    early = df.where("datetime < '2024-03-01'")
    sketches.write_days(sketches.day_sketches(early, feats, k=k), path)
    sketches.write_days(sketches.day_sketches(df.where("datetime >= '2024-02-20'"), feats, k=k), path)  # days sent again are replaced
    got = sketches.stored_baseline(spark, path)
    assert {r.feature: r.n for r in got.collect()} == dict.fromkeys(feats, 20_000)
    assert [r.within_bound for r in sketches.rank_check(df, got, feats, k=k).collect()] == [True] * 3
    part = sketches.stored_baseline(spark, path, "2024-01-10", "2024-02-10")
    inside = df.where("datetime >= '2024-01-10' and datetime < '2024-02-10'")
    assert [r.within_bound for r in sketches.rank_check(inside, part, feats, k=k).collect()] == [True] * 3
    wrong = got.withColumn("median", F.col("median") + 1)
    assert {r.feature: r.within_bound for r in sketches.rank_check(df, wrong, feats, k=k).collect()}["a"] is False
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
