"""Boosting, its metric and stopping, the model store, fold-local forests, folds in time order."""

import datetime as dt
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetrisk.models import boost, iforest, store
from fleetrisk.models.gbt import BoostParams
from fleetrisk.operators import folds, metrics, ranking

SMALL = BoostParams(max_iter=6, max_depth=3, step_size=0.3)


def average_precision(y, s):
    total, tp, n, area = sum(y), 0, 0, 0.0
    for v in sorted(set(s), reverse=True):
        hit = [a for a, b in zip(y, s) if b == v]
        tp, n = tp + sum(hit), n + len(hit)
        area += sum(hit) * tp / n
    return area / total if total else 0.0


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        a, b, c = rng.random(), rng.random(), float(rng.randrange(5))
        z = 3 * a - 2 * b + (c == 2) + rng.gauss(0, 0.7)
        rows.append((i, a, b if i % 50 else None, c, int(z > 0.8), 0 if z < 0.2 else 1 if z < 1.2 else 2, i % 4 == 3))
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int, y3 int, val boolean").repartition(3).cache()


FEATS = ["a", "b", "c"]


def matrix_of(rows):
    return np.array([[boost.MISSING if r[f] is None else r[f] for f in FEATS] for r in rows], float)


def test_pr_auc(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2) if g < 2 else 0, round(rng.random(), rng.choice([1, 6])), g) for g in range(3) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double, g int")
    got = {r.g: r.pr_auc for r in metrics.pr_auc(df, "y", "s", ["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(average_precision([r[0] for r in rows if r[2] == g], [r[1] for r in rows if r[2] == g]))


def test_tree_description(spark):
    text = """DecisionTreeRegressionModel: uid=x, depth=2, numNodes=5, numFeatures=3
  If (feature 1 <= 0.25)
   Predict: 1.0
  Else (feature 1 > 0.25)
   If (feature 0 <= -3.0E-4)
    Predict: 2.0
   Else (feature 0 > -3.0E-4)
    Predict: 3.0
"""
    nodes = boost.tree_nodes(text)
    assert [(n["feature"], n["threshold"], n["left"], n["right"]) for n in nodes] == [(1, 0.25, 1, 2), (-1, 0.0, -1, -1), (0, -3e-4, 3, 4), (-1, 0.0, -1, -1), (-1, 0.0, -1, -1)]
    assert boost._set_values(nodes, {0: (2.0, 1.0), 1: (3.0, 2.0)}) == [1.0, 1.0, 0.0] and nodes[0]["value"] == 5 / 4
    with pytest.raises(ValueError):
        boost.tree_nodes("x\n If (feature 1 in {0.0})\n  Predict: 1\n Else\n  Predict: 2")


def test_best_round():
    assert boost.best_round([0.1, 0.5, 0.5, 0.4], 5) == (2, False)
    assert boost.best_round([0.1, 0.5, 0.5, 0.4, 0.9], 3) == (5, False)
    assert boost.best_round([0.1, 0.5, 0.5, 0.4, 0.3, 0.9], 3) == (2, True)
    assert boost.best_round([], 3) == (0, False)


def test_binary_rounds_equal_brute_force(spark, data):
    model = boost.fit(data, FEATS, "y", (0, 1), SMALL, "val", patience=2, block=3)
    held = data.where("val").collect()
    whole = replace(model, rounds=len(model.history))  # what was trained is cut after the best round
    p = 1 / (1 + np.exp(-boost.staged_margins(matrix_of(held), model)[:, :, 0]))
    want = [average_precision([r.y for r in held], np.round(q * boost.BINS) / boost.BINS) for q in p]
    assert model.rounds == boost.best_round(model.history, 2)[0] and len(model.history) >= model.rounds
    assert model.history[:model.rounds] == pytest.approx(want, abs=1e-9) and whole.rounds >= model.rounds
    scored = {r.k: r for r in boost.score_binary(model, data).collect()}
    got = np.array([scored[r.k].p_failure for r in held])
    assert np.allclose(got, p[-1]) and all(r.pred_binary == (r.p_failure >= 0.5) for r in scored.values())
    assert metrics.roc_auc(boost.score_binary(model, data.where("val")), "y", "p_failure").first().auc > 0.8
    staged = {r.k: r.m for r in boost.margins(model, data.where("val"), "m", staged=True).collect()}
    assert np.allclose([staged[r.k] for r in held], boost.staged_margins(matrix_of(held), model).transpose(1, 0, 2))
    # the node table that explanations read adds up to the margin
    from fleetrisk.models.explain import _arrays, contributions
    c, bias = contributions(matrix_of(held), _arrays(model.node_table()))
    assert np.allclose(c.sum(axis=1) + bias, boost.raw_margins(matrix_of(held), model)[:, 0])


def test_softmax_log_loss_falls(spark, data):
    model = boost.fit(data, FEATS, "y3", (0, 1, 2), SMALL, "val", patience=50, block=3)
    assert model.metric == "neg_log_loss" and len(model.history) == 6 and model.history[-1] > model.history[0]
    rows = boost.score_multiclass(model, data).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.risk_class == int(np.argmax(r.probs)) and abs(r.failure_probability - 1 + r.probs[0]) < 6e-5 for r in rows)
    held = [r for r in rows if r.val]
    assert model.history[model.rounds - 1] == pytest.approx(np.mean([np.log(r.probs[r.y3]) for r in held]))
    assert np.mean([r.risk_class == r.y3 for r in held]) > 0.55


def test_without_validation_and_one_class(spark, data):
    model = boost.fit(data, FEATS, "y", (0, 1), replace(SMALL, max_iter=4), block=3)
    assert model.rounds == 4 and model.history == [] and set(model.nodes["round"]) == {0, 1, 2, 3}
    one = boost.fit(data.where("y = 1"), FEATS, "y", (0, 1), SMALL, "val")
    assert one.rounds == 0 and boost.score_binary(one, data).where("p_failure < 0.99").count() == 0
    none = boost.fit(data.limit(0), FEATS, "y", (0, 1), SMALL)
    assert boost.score_binary(none, data.limit(3)).select("p_failure").distinct().collect()[0][0] == 0.5


def test_weights_and_balanced(spark, data):
    heavy = boost.train_binary(data, FEATS, "y", replace(SMALL, max_iter=1))
    assert abs(heavy.base[0]) < 1e-9  # classes weigh the same
    flat = boost.train_multiclass(data, FEATS, "y3", replace(SMALL, max_iter=1), balanced=True)
    assert np.allclose(flat.base, np.log(1 / 3))


def test_store_trains_once(spark, data, tmp_path):
    calls = []

    def train():
        calls.append(1)
        return boost.fit(data, FEATS, "y3", (0, 1, 2), replace(SMALL, max_iter=2), "val")
    path = str(tmp_path / "m")
    a, b = (store.boosted(spark, path, train) for _ in range(2))
    assert len(calls) == 1 and a.nodes.equals(b.nodes) and (a.features, a.classes, a.base, a.history, a.rounds) == (b.features, b.classes, b.base, b.history, b.rounds)
    x = matrix_of(data.limit(50).collect())
    assert np.array_equal(boost.raw_margins(x, a), boost.raw_margins(x, b))
    assert store.model_path(spark, "m", "d", {"x": 1}) != store.model_path(spark, "m", "d2", {"x": 1}) != store.model_path(spark, "m", "d", {"x": 2})


def test_queries_share_stored_models(spark):
    """A second query on the same data trains nothing."""
    import __spark_entry__ as E
    from fleetrisk.plans import model_queries as q
    sf = "/root/testdata/sf0.001"
    few = BoostParams(max_iter=2, max_depth=2)
    first = q.binary_model(spark, sf, few)
    old = boost.fit
    try:
        boost.fit = None
        assert q.binary_model(spark, sf, few).nodes.equals(first.nodes)
    finally:
        boost.fit = old
    assert {"softmax_multiclass", "boosting_rounds", "light_training_metrics", "pr_auc", "walk_forward_time"} <= set(E.queries())


def test_forests_of_folds(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(900)], "k long, a double, b double").cache()
    trains = [F.col("k") < 400, F.col("k") < 800]
    forests = iforest.fit_many(df, ["a", "b"], ["k"], trains, n_trees=8, psi=32)
    # what a forest doesn't train on has no influence on it
    changed = df.withColumn("a", F.when(F.col("k") >= 400, F.col("a") + 1000).otherwise(F.col("a")))
    again = iforest.fit_many(changed, ["a", "b"], ["k"], trains, n_trees=8, psi=32)
    nodes = lambda f: sorted(map(tuple, f.nodes.collect()))
    assert nodes(forests[0]) == nodes(again[0]) and forests[0].offset == again[0].offset and nodes(forests[1]) != nodes(again[1])
    alone = iforest.fit(df.where(trains[0]), ["a", "b"], ["k"], n_trees=8, psi=32)
    assert nodes(alone) == nodes(forests[0])
    with pytest.raises(ValueError, match="drew no rows"):
        iforest.fit_many(df, ["a", "b"], ["k"], [F.col("k") < 0], n_trees=8, psi=32)


@pytest.mark.parametrize("anomaly, order", [("fold", "time"), ("global", "entity")])
def test_training_modes(spark, anomaly, order, tmp_path):
    from fleetrisk.plans.store import featured_table
    from fleetrisk.plans.training import run_training
    f = featured_table(spark, "/root/testdata/sf0.001").select("inverter_id", "datetime", "inv_power", "inv_temp", "hour", "alarm_count_7d", "target_binary", "target_multiclass")
    out = run_training(spark, f, replace(SMALL, max_iter=2), n_splits=2, n_trees=4, anomaly=anomaly, order=order, patience=2, save_dir=str(tmp_path / "t"))
    assert out["per_fold"].count() == 2 * 7 and {r.metric for r in out["holdout"].collect()} == {"precision", "recall", "f1", "auc"}
    assert set(out["forests"]) == ({None} if anomaly == "global" else {0, 1, "holdout"})
    assert boost.load(spark, str(tmp_path / "t/binary_model")).features[-2:] == ("anomaly_score", "is_anomaly")


def test_time_order_and_purge(spark):
    rng = random.Random(6)
    hours = [(f"i{rng.randrange(4)}-{n}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(600))) for n in range(130)]
    df = spark.createDataFrame(hours, "inverter_id string, datetime timestamp_ntz")
    got = folds.with_purge(folds.walk_forward_folds(df, 5, order="time"), 48).collect()
    order = sorted(hours, key=lambda r: (r[1], r[0]))
    t = 130 // 6
    starts = [130 - (5 - k) * t for k in range(5)]
    for r in got:
        p = order.index((r.inverter_id, r.datetime))
        assert r.row_pos == p and r.test_fold == next((k for k in reversed(range(5)) if p >= starts[k]), None)
        trains = [k for k in range(5) if p < starts[k] and r.datetime + dt.timedelta(hours=48) <= order[starts[k]][1]]
        before = [k for k in range(5) if p < starts[k]]
        assert r.trains_from == (trains[0] if trains else None)
        purged = before and (not trains or before[0] < trains[0])
        assert r.purged_from == (before[0] if purged else None)
    assert {r.row_pos for r in ranking.time_positions(df).collect()} == set(range(130))


def test_rounds_read_kept_leaves(spark, data, monkeypatch):
    """What a block writes reads the leaves of its last round; no tree is run again above them, and nothing stays persisted."""
    plans, write = [], boost.materialize

    def seen(df):
        if "_stage" in df.columns:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)
    monkeypatch.setattr(boost, "materialize", seen)
    data.count()  # cached by now
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    model = boost.fit(data, FEATS, "y3", (0, 1, 2), SMALL, "val", patience=50, block=3)
    assert len(model.history) == 6 and len(plans) == 2
    assert all("InMemoryRelation" in p and "UDF" not in p.split("InMemoryRelation")[0] for p in plans), plans
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_later_rounds_run_one_code(spark, data, monkeypatch):
    """Neither the round's number nor its leaf values are compiled into the code that a round's trees read their rows by."""
    codes = []

    class Seen(boost.RandomForestRegressor):
        def fit(self, rows):
            stages = rows._jdf.queryExecution().debug().codegenToSeq()
            codes.append([stages.apply(i)._2() for i in range(stages.size())])
            return super().fit(rows)
    monkeypatch.setattr(boost, "RandomForestRegressor", Seen)
    model = boost.fit(data, FEATS, "y", (0, 1), replace(SMALL, max_iter=4, subsample=0.8), "val", block=4)
    assert len(model.history) == 4 and len(codes) == 4
    assert codes[2] and codes[2] == codes[3]  # from the third on; before it margins can't be null, so two rounds have their own


def test_small_tables_take_few_tasks(spark, monkeypatch):
    """3,000 rows in eight partitions: a round's 25 passes take a task each; the model doesn't depend on it."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, (3000, 3))
    y = ((x[:, 0] > 30) ^ (x[:, 1] > 20) ^ (rng.random(3000) < 0.2)).astype(int)  # no leaf is pure
    rows = spark.createDataFrame([(*map(int, r), int(v), i % 5 == 0) for i, (r, v) in enumerate(zip(x, y))], "a int, b int, c int, target_binary int, held boolean").repartition(8)
    rows = boost.materialize(rows)
    one_round, parts = boost._one_round, []

    def counted(now, *more):
        parts.append(now.rdd.getNumPartitions())
        return one_round(now, *more)
    monkeypatch.setattr(boost, "_one_round", counted)
    fit = lambda **tasks: boost.train_binary(rows, ["a", "b", "c"], params=BoostParams(max_iter=4, max_depth=3), validation="held", patience=9, **tasks)
    few = fit(part_rows=boost.PART_ROWS)
    assert parts == [1] * 4
    parts.clear()
    many = fit()
    assert max(parts) > 1 and few.rounds == many.rounds
    np.testing.assert_allclose(few.history, many.history, rtol=1e-3)  # probabilities are counted in bins: a last digit may move a row
    assert few.nodes[["feature", "left", "right"]].values.tolist() == many.nodes[["feature", "left", "right"]].values.tolist()
    np.testing.assert_allclose(few.nodes[["threshold", "value"]].astype(float), many.nodes[["threshold", "value"]].astype(float))
