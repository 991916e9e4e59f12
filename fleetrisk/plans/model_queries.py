"""Registered model queries (rows-only checks: trained models have no SQL twin).

Models are trained at full settings (``gbt.BoostParams``: at most 500 rounds, patience 50); the positional hold-out, the last fifth
of the rows, stops the boosting. They are stored by a fingerprint of the featured table, settings and code (``models.store``):
the first query that needs one trains it, all others load it.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from ..models import boost, explain, gbt, iforest, shapley, store
from ..operators import folds, matrix, ranking, risk, serving
from ..schema import KEY_FEATURES
from ..session import materialize
from .analysis_queries import AVAILABLE_KEYS, featured
from .catalog import register, rounded
from .store import baseline_table, featured_store_path
from .feature_queries import KEYS

HELD = "held_out"


def training_frame(spark, sf):
    """Key features and targets of every reading, and whether the reading only stops the boosting."""
    d = folds.holdout_split(matrix.key_feature_frame(featured(spark, sf), keep=KEYS))
    return materialize(d.withColumn(HELD, ~F.col("is_train")).drop("is_train", "row_pos"))


def rows_of(spark, sf):
    """Key features and targets of every reading."""
    return matrix.key_feature_frame(featured(spark, sf), keep=KEYS)


def _path(spark, sf, kind, **settings):
    return store.model_path(spark, kind, featured_store_path(spark, sf), {"features": AVAILABLE_KEYS} | settings)


def binary_model(spark, sf, params=gbt.BoostParams()):
    """The stored binary model."""
    return store.boosted(spark, _path(spark, sf, "binary", **asdict(params)),
                         lambda: boost.train_binary(training_frame(spark, sf), AVAILABLE_KEYS, params=params, validation=HELD))


def multiclass_model(spark, sf, params=gbt.BoostParams()):
    """The stored 3-class model."""
    return store.boosted(spark, _path(spark, sf, "multiclass", **asdict(params)),
                         lambda: boost.train_multiclass(training_frame(spark, sf), AVAILABLE_KEYS, params=params, validation=HELD))


def both_models(spark, sf):
    """The stored binary and 3-class models, trained side by side where they are missing."""
    featured(spark, sf)  # built once, not by both
    return gbt.side_by_side(spark, [lambda: binary_model(spark, sf), lambda: multiclass_model(spark, sf)])


def forest_model(spark, sf, n_trees, contamination):
    """The stored isolation forest, fitted on all rows."""
    return store.forest(spark, _path(spark, sf, "forest", n_trees=n_trees, contamination=contamination),
                        lambda: iforest.fit(rows_of(spark, sf), AVAILABLE_KEYS, KEYS, n_trees=n_trees, contamination=contamination))


@register("gbt_binary")
def q_gbt_binary(spark, sf):
    """ML1: weighted binary model, stopped on PR-AUC with patience 50, scored on every row."""
    out = boost.score_binary(binary_model(spark, sf), rows_of(spark, sf))
    return rounded(out.select(*KEYS, "target_binary", F.col("pred_binary").cast("int").alias("prediction"),
                              "p_failure"))


@register("softmax_multiclass")
def q_softmax_multiclass(spark, sf):
    """ML2 + FN13: one joint softmax model, stopped on log loss with patience 50; probabilities, argmax, 1 - P(no risk)."""
    out = boost.score_multiclass(multiclass_model(spark, sf), rows_of(spark, sf))
    return rounded(out.select(*KEYS, "target_multiclass", "risk_class", "failure_probability", *(F.col("probs")[k].alias(f"p{k}") for k in range(3)),
                              risk.risk_level(F.col("risk_class")).alias("risk_level")))


@register("boosting_rounds")
def q_boosting_rounds(spark, sf):
    """ML1 + ML2: the validation metric after every round that was trained, and whether the round was kept."""
    rows = [(name, i + 1, m.metric, float(v), i < m.rounds) for name, m in zip(("binary", "multiclass"), both_models(spark, sf))
            for i, v in enumerate(m.history)]
    return spark.createDataFrame(rows, "model string, round int, metric string, value double, kept boolean")


@register("ovr_multiclass")
def q_ovr_multiclass(spark, sf):
    """ML2 + FN13: one-vs-rest 3-class GBT, normalised class probabilities, argmax, 1 - P(no risk)."""
    d = training_frame(spark, sf)
    out = gbt.score_multiclass(gbt.train_multiclass(d, AVAILABLE_KEYS, validation=HELD), d)
    return out.select(*KEYS, "target_multiclass", "risk_class", "failure_probability",
                      risk.risk_level(F.col("risk_class")).alias("risk_level"))


@register("anomaly_scores")
def q_anomaly_scores(spark, sf):
    """ML4 + ML5: isolation forest (200 trees, contamination 0.05) fitted on all rows, scored on all rows."""
    return rounded(iforest.add_anomaly_scores(rows_of(spark, sf), forest_model(spark, sf, 200, 0.05))
                   .select(*KEYS, "anomaly_score", "is_anomaly"))


@register("batch_score")
def q_batch_score(spark, sf):
    """ML17: sparse readings -> completion (SV*) -> stored 3-class model, isolation forest, drivers of the binary model
    -> prediction records."""
    binary, model = both_models(spark, sf)
    nodes = binary.node_table()
    forest = forest_model(spark, sf, 100, 0.15)
    dense = serving.complete_readings(serving.readings_from_featured(featured(spark, sf)), baseline_table(spark, sf), KEY_FEATURES)
    scored = iforest.add_anomaly_scores(dense, forest)
    scored = boost.score_multiclass(model, explain.add_drivers(scored, nodes, AVAILABLE_KEYS))
    lvl = risk.risk_level(F.col("risk_class"))
    factors = F.transform("top_risk_factors", lambda d: d.withField("value", F.round(d["value"], 4))
                          .withField("impact", F.round(d["impact"], 4)))
    return scored.select("reading_id", "inverter_id", "failure_probability", lvl.alias("risk_level"),
                         "risk_class", (F.col("is_anomaly") == 1).alias("is_anomaly"),
                         F.round("anomaly_score", 4).alias("anomaly_score"), factors.alias("top_risk_factors"),
                         risk.recommendation(lvl).alias("recommendation"))


@register("explain_global")
def q_explain_global(spark, sf):
    """ML14: top-10 features by mean |path attribution| of the binary model over all rows."""
    return explain.top_features(rows_of(spark, sf), binary_model(spark, sf).node_table(), AVAILABLE_KEYS)


@register("explain_rows")
def q_explain_rows(spark, sf):
    """ML15 + SK5 + FN14: per-row top-5 drivers (value, signed impact, direction) and base value."""
    top = explain.add_drivers(rows_of(spark, sf).select(*KEYS, *AVAILABLE_KEYS), binary_model(spark, sf).node_table(), AVAILABLE_KEYS)
    each = top.select(*KEYS, "base_value", F.posexplode("top_risk_factors").alias("rank", "driver"))
    return each.select(*KEYS, (F.col("rank") + 1).alias("rank"), "driver.feature", F.round("driver.value", 4).alias("value"),
                       F.round("driver.impact", 4).alias("impact"), "driver.direction", "base_value")


#: Settings of the registered cross-validations, 5 folds x 2 tasks each: a fit of one small tree costs MLlib half a second whatever its rows.
#: The patience ends within a block of rounds.
CV_PATIENCE, LIGHT_ROUNDS = boost.BLOCK - 1, 5


def _stored_table(spark, sf, kind, build, **settings):
    """A small result table kept like a model: built by the first query, read by the others."""
    path = _path(spark, sf, kind, **settings)
    return store.stored(spark, path, build, lambda df, p: df.coalesce(1).write.mode("overwrite").parquet(f"{p}/meta"), lambda p: spark.read.parquet(f"{p}/meta"))


def _long(res):
    cv = res["aggregate"].select(F.concat("task", F.lit("_cv")).alias("section"), "metric", F.col("mean").alias("value"))
    tf = res["top_features"].select(F.lit("top_features").alias("section"), F.col("feature").alias("metric"), F.col("mean_abs_impact").alias("value"))
    if "holdout" not in res:
        return cv.unionByName(tf)
    return cv.unionByName(res["holdout"].select(F.lit("holdout_binary").alias("section"), "metric", "value")).unionByName(tf)


@register("explain_latest_shapley")
def q_explain_latest_shapley(spark, sf):
    """ML15 + WN6: Shapley values of each inverter's latest reading (32 antithetic pairs, 64 background rows), best five, with their standard errors."""
    model = binary_model(spark, sf)
    background = shapley.background_rows(rows_of(spark, sf), model.features, KEYS)
    latest = ranking.latest_per_entity(featured(spark, sf).select(*KEYS, *AVAILABLE_KEYS))
    top = shapley.add_shapley(matrix.pad_to_model(latest, AVAILABLE_KEYS, keep=KEYS), model, background)
    each = top.select(*KEYS, "base_value", F.posexplode("top_risk_factors").alias("rank", "driver"))
    return rounded(each.select(*KEYS, (F.col("rank") + 1).alias("rank"), "driver.*", "base_value"))


@register("training_metrics")
def q_training_metrics(spark, sf):
    """ML16: anomaly features -> walk-forward CV (binary + 3-class, patience ``CV_PATIENCE``) -> hold-out -> attribution.

    Output: long metrics table (section, metric, value) over CV means, hold-out and top features.
    """
    from .training import run_training
    return _stored_table(spark, sf, "training-metrics", lambda: _long(run_training(spark, featured(spark, sf), patience=CV_PATIENCE)), patience=CV_PATIENCE)


@register("light_training_metrics")
def q_light_training_metrics(spark, sf):
    """ML3 + ML8: the light job with ``LIGHT_ROUNDS`` rounds: stratified CV means and the attribution of the final binary model."""
    from dataclasses import replace

    from .training import run_light_training
    light = replace(gbt.LIGHT, max_iter=LIGHT_ROUNDS)
    return _stored_table(spark, sf, "light-metrics", lambda: _long(run_light_training(spark, featured(spark, sf), AVAILABLE_KEYS, light)), **asdict(light))


def _scored_readings(spark, sf, readings, keep):
    """Stored readings, padded to the models' features, scored by the stored binary and 3-class models."""
    rows = matrix.pad_to_model(readings, AVAILABLE_KEYS, keep=keep)
    binary, multiclass = both_models(spark, sf)
    return boost.score_multiclass(multiclass, boost.score_binary(binary, rows))


@register("score_latest")
def q_score_latest(spark, sf):
    """ML18 + WN7 + RP4: each inverter's last 10 stored readings scored by the models (the trend)."""
    recent = ranking.last_n_per_entity(featured(spark, sf).select(*KEYS, *AVAILABLE_KEYS), 10)
    s = _scored_readings(spark, sf, recent, KEYS + ["reading_no"])
    return s.select(*KEYS, "reading_no", F.round("p_failure", 6).alias("failure_prob"), "risk_class",
                    risk.risk_display(F.col("risk_class")).alias("risk_label"))


@register("model_risk_board")
def q_model_risk_board(spark, sf):
    """RP3 + SK3 on trained models: each inverter's latest reading scored, as the full risk table."""
    latest = ranking.latest_per_entity(featured(spark, sf).select(*KEYS, "plant_id", *AVAILABLE_KEYS))
    s = _scored_readings(spark, sf, latest, ["inverter_id", "plant_id"])
    prob = F.round("p_failure", 6)
    return s.select("inverter_id", "plant_id", prob.alias("failure_prob"), risk.percent(F.col("p_failure")).alias("failure_prob_text"),
                    "risk_class", risk.risk_display(F.col("risk_class")).alias("risk_label")).orderBy(F.desc("failure_prob"), "inverter_id")
