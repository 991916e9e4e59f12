import pytest
"""Model operators: folds, isolation forest, metrics on toy data."""

from pyspark.sql import functions as F

from fleetrisk.models import iforest
from fleetrisk.operators import folds, metrics


def test_walk_forward_bounds(spark):
    df = spark.range(13).select(F.col("id").alias("row_pos"), F.lit("i").alias("inverter_id"))
    out = {r.row_pos: r.test_fold for r in folds.walk_forward_folds(df).collect()}
    starts = [min(p for p, f in out.items() if f == k) for k in range(5)]
    assert starts == [3, 5, 7, 9, 11]  # T8: n=13, t=2


def test_stratified_balance(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    sizes = folds.stratified_folds(df, "y", ["k"], digits=1).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in sizes if r.y == y]
        assert max(c) - min(c) <= 1


def test_auc_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, score double")
    # pairs (pos, neg): (.9,.9)=.5, (.9,.1)=1, (.5,.9)=0, (.5,.1)=1 -> 2.5 / 4
    assert metrics.roc_auc(df, "y", "score").first().auc == 0.625


def test_iforest_flags_outlier(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(500)] + [(999, 500.0, 400.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    forest = iforest.fit(df, ["a", "b"], ["k"], n_trees=50, psi=128, contamination=0.05)
    out = iforest.add_anomaly_scores(df, forest)
    worst = out.orderBy("anomaly_score").first()
    assert worst.k == 999 and worst.is_anomaly == 1
    # about the contaminated share of the training rows is flagged, and a row alone gets its flag of the batch
    flags = {r.k: (r.anomaly_score, r.is_anomaly) for r in out.collect()}
    assert 0.01 <= sum(f for _, f in flags.values()) / len(flags) <= 0.08
    for k in (3, 250, 999):
        alone = iforest.add_anomaly_scores(df.where(F.col("k") == k), forest).first()
        assert (alone.anomaly_score, alone.is_anomaly) == flags[k]


def test_iforest_saved_with_what_scoring_needs(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(300)], "k long, a double, b double")
    forest = iforest.fit(df, ["a", "b"], ["k"], n_trees=10, psi=64)
    iforest.save_forest(forest, str(tmp_path / "forest"))
    back = iforest.load_forest(spark, str(tmp_path / "forest"))
    assert (back.features, back.sample_size, back.offset) == (("a", "b"), 64, forest.offset)
    same = iforest.score(df, forest).join(iforest.score(df, back).withColumnRenamed("iso_score", "again"), ["k", "a", "b"])
    assert same.where("iso_score <> again").count() == 0 and same.count() == 300


def test_iforest_draws_whole_samples_from_huge_tables(spark):
    # 4M rows stand for the share of 10^9 rows that falls to 1/250 of the trees' slots
    n, trees, psi = 1_000_000_000, 50_000, 256
    drawn = (spark.range(4_000_000).select(F.explode(iforest.tree_draws(F.xxhash64("id"), n, trees, psi, 42)).alias("tree")))
    expected = 4_000_000 * 1.5 * psi / n * trees
    assert abs(drawn.count() - expected) < 6 * expected ** 0.5
    assert 0 <= drawn.agg(F.min("tree")).first()[0] and drawn.agg(F.max("tree")).first()[0] < trees
    df = spark.createDataFrame([(1, 1.0)], "k long, a double")
    with pytest.raises(ValueError, match="drew no rows"):
        iforest.fit(df, ["a"], ["k"], n_trees=5, psi=2, n_rows=n)


def test_path_attribution_additivity(spark):
    from pyspark.ml.functions import vector_to_array
    from fleetrisk.models import explain, gbt
    rows = [(i, float(i % 7), float((i * 3) % 11), int((i % 7) > 3 or (i % 11) == 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, target_binary int")
    model = gbt.train_binary(df, ["a", "b"], params=gbt.BoostParams(max_iter=5, max_depth=3))
    nodes = explain.gbt_nodes(spark, model.stages[-1])
    att = explain.attribute(df, nodes, ["a", "b"], ["k"])
    sums = {r.k: (r.s, r.b) for r in att.groupBy("k").agg(F.sum("impact").alias("s"), F.first("base_value").alias("b")).collect()}
    margin = {r.k: r.m for r in model.transform(df).select("k", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert all(abs(sums[k][0] + sums[k][1] - margin[k]) < 1e-9 for k in margin)


def test_stratified_cv_light(spark):
    from fleetrisk.models import gbt
    from fleetrisk.plans.store import featured_table
    from fleetrisk.plans.training import stratified_cv
    f = featured_table(spark, "/root/testdata/sf0.001")
    out = stratified_cv(f, ["inv_power", "inv_temp", "alarm_count_7d", "hour"], gbt.BoostParams(max_iter=2, max_depth=3))
    rows = out.collect()
    assert len(rows) == 5 * 7 and all(0.0 <= r.value <= 1.0 for r in rows)


def test_entity_filter_pushdown(spark):
    from fleetrisk.operators.ranking import readings_of
    from fleetrisk.plans.store import featured_table
    f = featured_table(spark, "/root/testdata/sf0.001", columns=["inverter_id", "datetime", "inv_power"])
    r = readings_of(f, "Plant_1_MAC0_INV0")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(inverter_id), EqualTo(inverter_id,Plant_1_MAC0_INV0)]" in plan
    ts = [x.datetime for x in r.collect()]
    assert ts == sorted(ts) and len(ts) > 0


def test_global_positions_brute_force(spark):
    import datetime as dt
    from pyspark.sql import Window
    from fleetrisk.operators.ranking import global_positions
    rows = [(f"e{e:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for e in range(60) for h in range(e % 7 + 1)]
    df = spark.createDataFrame(rows, "inverter_id string, datetime timestamp_ntz")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.inverter_id, r.datetime): r.row_pos for r in global_positions(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {(r.inverter_id, r.datetime): r.p for r in df.select(
        "*", (F.row_number().over(Window.orderBy("inverter_id", "datetime")) - 1).alias("p")).collect()}
    assert got == want


def test_exact_median_rounds_match_brute_force(spark):
    import statistics
    from fleetrisk.operators.stats import exact_median_long
    rows = [("a", float((i * 7919) % 1013) / 7.0) for i in range(5001)] + [("b", float(i % 5)) for i in range(4000)] \
        + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "feature string, value double")
    got = {r.feature: r.median for r in exact_median_long(df).collect()}
    for k in ("a", "b", "c"):
        want = statistics.median([v for f, v in rows if f == k and v is not None])
        assert abs(got[k] - want) < 1e-12, (k, got[k], want)


def test_drivers_agree_with_long_attribution(spark):
    from fleetrisk.models import explain, gbt
    rows = [(i, float(i % 7), float((i * 3) % 11), 0.0, int((i % 7) > 3 or (i % 11) == 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, target_binary int")
    feats = ["c", "b", "a"]
    nodes = explain.gbt_nodes(spark, gbt.train_binary(df, feats, params=gbt.BoostParams(max_iter=4, max_depth=3)).stages[-1])
    long = {}
    for r in explain.attribute(df, nodes, feats, ["k"]).collect():
        long.setdefault(r.k, []).append((-abs(r.impact), r.feature, r.impact))
    for r in explain.add_drivers(df, nodes, feats, 2).collect():
        want = [(f, i, "increases risk" if i > 0 else "decreases risk") for _, f, i in sorted(long[r.k])[:2]]
        assert [(d.feature, d.impact, d.direction) for d in r.top_risk_factors] == want
    means = {r.feature: r.mean_abs_impact for r in explain.mean_impacts(df, nodes, feats).collect()}
    for j, f in enumerate(feats):
        assert abs(means[f] - sum(abs(i) for v in long.values() for _, g, i in v if g == f) / 300) < 1e-9


def test_light_training_job(spark, tmp_path):
    from fleetrisk.models import gbt, iforest
    from fleetrisk.plans.store import featured_table
    from fleetrisk.plans.training import run_light_training
    out = run_light_training(spark, featured_table(spark, "/root/testdata/sf0.001"), ["inv_power", "inv_temp", "hour", "absent"],
                             gbt.BoostParams(max_iter=2, max_depth=2), n_splits=2, n_trees=5, save_dir=str(tmp_path / "light"))
    assert out["feature_names"] == ["inv_power", "inv_temp", "hour"]
    assert {r.feature for r in out["baseline"].collect()} == set(out["feature_names"]) == {r.feature for r in out["top_features"].collect()}
    assert out["per_fold"].count() == 2 * 7
    assert iforest.load_forest(spark, str(tmp_path / "light/anomaly_model")).features == tuple(out["feature_names"])


def test_topk_attribution_row_names_positions(spark):
    """Rows are named by their position in the (inverter, time) order of the whole table, five drivers each."""
    import __spark_entry__ as E
    from fleetrisk.operators.ranking import global_positions
    from fleetrisk.plans.store import featured_table
    sf = "/root/testdata/sf0.001"
    got = E.queries()["topk_attribution_row"](spark, sf)
    assert got.columns == ["row_id", "rank", "feature", "value", "impact", "direction"]
    rows, n = got.collect(), featured_table(spark, sf).count()
    assert sorted((r.row_id, r["rank"]) for r in rows) == [(i, k) for i in range(n) for k in range(1, 6)]
    power = {r.row_pos: r.inv_power for r in global_positions(featured_table(spark, sf)).collect()}
    shown = [r for r in rows if r.feature == "inv_power"]
    assert shown and all(abs(r.value - (power[r.row_id] or 0.0)) < 1e-5 for r in shown)
