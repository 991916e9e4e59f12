"""Full training job (ML16): anomaly features, walk-forward CV, hold-out, final models, attribution.

Every step is a Spark job over the stored featured table; fold membership is a
column (``test_fold``, ``row_pos``), so each fit reads the same checkpointed
matrix filtered by position instead of materialising fold copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import boost, explain, gbt, iforest
from ..operators import folds, matrix, metrics
from ..schema import KEY_FEATURES
from ..session import materialize
from ..sources.sinks import write_json_table


def _fold_rows(task: str, fold: int, m: DataFrame, names: Sequence[str]) -> DataFrame:
    return metrics.to_long(m.select(*names), [], names).select(
        F.lit(task).alias("task"), F.lit(fold).alias("fold"), "metric", "value")


def run_training(spark: SparkSession, featured: DataFrame, params: gbt.BoostParams = gbt.BoostParams(),
                 n_splits: int = 5, contamination: float = 0.05, n_trees: int = 200,
                 keys: Sequence[str] = ("inverter_id", "datetime"), save_dir: str | None = None,
                 anomaly: str = "global", order: str = "entity", patience: int = 50) -> dict:
    """Returns DataFrames: ``per_fold`` (task, fold, metric, value), ``aggregate`` (task, metric, mean, std),
    ``holdout`` (metric, value), ``top_features`` (rank, feature, mean_abs_impact).

    ``anomaly="global"`` fits one forest on all rows, as the reference does, so a fold's test rows have shaped their own anomaly features;
    ``"fold"`` grows a forest per fold (and one for the hold-out) on its training rows, in one job, and scores the fold's rows by it.
    ``order="time"`` lays folds out in time order and purges training rows whose label reaches into the test block.
    """
    if anomaly not in ("global", "fold"):
        raise ValueError(f"unknown anomaly mode {anomaly!r}")
    keys = list(keys)
    base = matrix.feature_matrix(featured, keep=keys + ["target_binary", "target_multiclass"])
    feats = [c for c in base.columns if c not in set(keys) | {"target_binary", "target_multiclass"}]
    base = materialize(folds.holdout_split(folds.walk_forward_folds(materialize(base), n_splits, order=order)))
    if order == "time":
        base = materialize(folds.with_purge(base))
    starts = {r.test_fold: r.p for r in base.where("test_fold is not null").groupBy("test_fold").agg(F.min("row_pos").alias("p")).collect()}
    before = {k: (F.col("row_pos") < p) & (F.col("trains_from") <= k if order == "time" else F.lit(True)) for k, p in starts.items()}
    # 1. anomaly detectors; scores become two more features
    if anomaly == "global":
        forests = {None: iforest.fit(base, feats, keys, n_trees=n_trees, contamination=contamination)}
        scored_by = dict.fromkeys([*starts, "holdout"], None)
    else:
        names = [*sorted(starts), "holdout"]
        conditions = [before[k] for k in sorted(starts)] + [F.col("is_train")]
        forests = dict(zip(names, iforest.fit_many(base, feats, keys, [F.coalesce(c, F.lit(False)) for c in conditions], n_trees=n_trees, contamination=contamination)))
        scored_by = {k: k for k in names}
    with_scores = {name: materialize(iforest.add_anomaly_scores(base, f)) for name, f in forests.items()}
    own = feats
    feats = feats + ["anomaly_score", "is_anomaly"]

    def fold(k: int, task: str) -> list[DataFrame]:
        if k not in starts:
            return []
        x = with_scores[scored_by[k]]
        test = x.where(F.col("test_fold") == k)
        # the fold under test is also the set that stops the boosting, as in the reference job
        seen = x.where(before[k] | (F.col("test_fold") == k)).withColumn("_val", F.col("row_pos") >= starts[k])
        if task == "binary":
            bm = boost.score_binary(boost.train_binary(seen, feats, params=params, validation="_val", patience=patience, part_rows=boost.PART_ROWS), test)
            b = metrics.binary_with_auc(bm, "target_binary", "pred_binary", "p_failure")
            return [_fold_rows("binary", k + 1, b, ["precision", "recall", "f1", "auc"])]
        mm = boost.score_multiclass(boost.train_multiclass(seen, feats, params=params, validation="_val", patience=patience, part_rows=boost.PART_ROWS), test)
        m = metrics.macro_metrics(mm, "target_multiclass", "risk_class")
        return [_fold_rows("multiclass", k + 1, m, ["precision_macro", "recall_macro", "f1_macro"])]
    x = with_scores[scored_by["holdout"]]
    split = x.withColumn("_val", ~F.col("is_train"))
    finals = [lambda: boost.train_binary(split, feats, params=params, validation="_val", patience=patience, part_rows=boost.PART_ROWS),
              lambda: boost.train_multiclass(split, feats, params=params, validation="_val", patience=patience, part_rows=boost.PART_ROWS)]
    # no fit waits for another one of its fold; those with most rows come first, so that none of them is left for the end
    fits = [lambda k=k, task=task: fold(k, task) for k in reversed(range(n_splits)) for task in ("binary", "multiclass")]
    final_bin, final_multi, *per_fold = gbt.side_by_side(spark, [*finals, *fits], parallelism=6)
    per_fold = sum(per_fold, [])
    series = per_fold[0]
    for p in per_fold[1:]:
        series = series.unionByName(p)
    series = materialize(series)
    test = x.where(~F.col("is_train"))
    hold = metrics.binary_with_auc(boost.score_binary(final_bin, test), "target_binary", "pred_binary", "p_failure")
    holdout = metrics.to_long(hold, [], ["precision", "recall", "f1", "auc"])
    top = materialize(explain.top_features(test, final_bin.node_table(), feats))
    out = {"per_fold": series, "aggregate": metrics.fold_aggregate(series), "holdout": holdout, "top_features": top, "feature_names": feats,
           "binary": final_bin, "multiclass": final_multi, "forests": forests, "raw_features": own}
    if save_dir:
        boost.save(final_bin, spark, f"{save_dir}/binary_model")
        boost.save(final_multi, spark, f"{save_dir}/multiclass_model")
        iforest.save_forest(forests[scored_by["holdout"]], f"{save_dir}/anomaly_model")
        write_json_table(out["aggregate"], f"{save_dir}/metrics_aggregate")
        write_json_table(series, f"{save_dir}/metrics_per_fold")
        write_json_table(holdout, f"{save_dir}/metrics_holdout")
        write_json_table(top, f"{save_dir}/top_features")
    return out


def stratified_cv(featured: DataFrame, features: Sequence[str], params: gbt.BoostParams = gbt.LIGHT,
                  n_splits: int = 5, seed: int = 42, keys: Sequence[str] = ("inverter_id", "datetime")) -> DataFrame:
    """ML3 + ML8: lightweight models under shuffled stratified k-fold CV.

    Binary: P/R/F1/AUC per fold; 3-class (unweighted): weighted P/R/F1. Each task's folds are
    stratified by the label that it trains on. Returns the long per-fold table (task, fold, metric, value).
    """
    keys = list(keys)
    base = matrix.key_feature_frame(featured, features, keep=keys)
    x = materialize(folds.stratified_folds(base, "target_binary", keys, n_splits, seed))
    y = materialize(folds.stratified_folds(base, "target_multiclass", keys, n_splits, seed))

    def fold(k: int) -> list[DataFrame]:
        bm = boost.score_binary(boost.train_binary(x.where(F.col("fold") != k), list(features), params=params), x.where(F.col("fold") == k))
        b = metrics.binary_with_auc(bm, "target_binary", "pred_binary", "p_failure")
        mm = boost.score_multiclass(boost.train_multiclass(y.where(F.col("fold") != k), list(features), params=params), y.where(F.col("fold") == k))
        w = metrics.weighted_metrics(mm, "target_multiclass", "risk_class")
        return [_fold_rows("binary", k + 1, b, ["precision", "recall", "f1", "auc"]),
                _fold_rows("multiclass", k + 1, w, ["precision_weighted", "recall_weighted", "f1_weighted"])]
    rows = sum(gbt.side_by_side(x.sparkSession, [lambda k=k: fold(k) for k in range(n_splits)]), [])
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def run_light_training(spark: SparkSession, featured: DataFrame, features: Sequence[str] = KEY_FEATURES,
                       params: gbt.BoostParams = gbt.LIGHT, n_splits: int = 5, n_trees: int = 100, contamination: float = 0.15,
                       keys: Sequence[str] = ("inverter_id", "datetime"), save_dir: str | None = None) -> dict:
    """ML3: the light retrain job: stratified CV, final models on all rows (3-class balanced), forest, baseline.

    Features that the table lacks are left out. Returns ``per_fold``, ``aggregate``, ``top_features`` (over all
    rows), ``baseline`` (feature, median) and ``feature_names``; ``save_dir`` gets the models beside them.
    """
    keys = list(keys)
    feats = matrix.available_key_features(featured, features)
    per_fold = materialize(stratified_cv(featured, feats, params, n_splits, keys=keys))
    rows = materialize(matrix.key_feature_frame(featured, feats, keep=keys))
    binary = boost.train_binary(rows, feats, params=params)
    multi = boost.train_multiclass(rows, feats, params=params, balanced=True)
    forest = iforest.fit(rows, feats, keys, n_trees=n_trees, contamination=contamination)
    top = materialize(explain.top_features(rows, binary.node_table(), feats))
    baseline = matrix.healthy_baseline(rows, feats)
    out = {"per_fold": per_fold, "aggregate": metrics.fold_aggregate(per_fold), "top_features": top,
           "baseline": baseline, "feature_names": feats}
    if save_dir:
        boost.save(binary, spark, f"{save_dir}/binary_model")
        boost.save(multi, spark, f"{save_dir}/multiclass_model")
        iforest.save_forest(forest, f"{save_dir}/anomaly_model")
        for name in ("per_fold", "aggregate", "top_features", "baseline"):
            write_json_table(out[name], f"{save_dir}/{name}")
    return out
