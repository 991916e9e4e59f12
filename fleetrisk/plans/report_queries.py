"""Registered queries: metrics, fold reports, risk board, attribution, serving, text, loader pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import to_double
from ..functions.timefns import parse_epoch_millis, parse_text_timestamp
from ..operators import folds, matrix, metrics, ranking, risk, serving, text
from ..schema import KEY_FEATURES, RISK_DISPLAY
from ..sources.csv_telemetry import unpivot_inverters
from ..sources.tables import read_table
from .analysis_queries import (AVAILABLE_KEYS, BASELINE_SQL, FEATURED_SQL, SCORED_SQL, _LATEST_SQL, featured,
                               scored)
from ..session import materialize
from .store import baseline_table
from .catalog import register, round6, rounded, sql_round6
from .feature_queries import KEYS

R = sql_round6


def _q(base: str, body: str) -> str:
    return f"{base}\n{body}"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------ metrics ---
_BIN_SQL = """SELECT tp, fp, fn, tn, {rp} AS precision, {rr} AS recall,
  {rf} AS f1 FROM (
  SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1x FROM (
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM (
      SELECT CAST(sum(CASE WHEN target_binary = 1 AND proxy_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN target_binary <> 1 AND proxy_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN target_binary = 1 AND proxy_pred <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(sum(CASE WHEN target_binary <> 1 AND proxy_pred <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
      FROM scored) c) p) q""".format(rp=R("pr"), rr=R("rc"), rf=R("f1x"))


@register("binary_metrics", _q(SCORED_SQL, _BIN_SQL))
def q_binary_metrics(spark, sf):
    """ML9: confusion counts, precision, recall, F1 (zero division -> 0)."""
    return rounded(metrics.binary_metrics(scored(spark, sf), "target_binary", "proxy_pred"))


_AUC_SQL = """SELECT {r} AS auc FROM (
  SELECT CASE WHEN p > 0 AND n > 0 THEN u / (p * n) ELSE 0.0 END AS a FROM (
    SELECT sum(pos * (neg_before + 0.5 * neg)) AS u, sum(pos) AS p, sum(neg) AS n FROM (
      SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
      FROM (SELECT proxy_prob AS s, sum(CASE WHEN target_binary = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN target_binary <> 1 THEN 1 ELSE 0 END) AS neg FROM scored GROUP BY 1) h) x) y) z""".format(r=R("a"))


@register("roc_auc", _q(SCORED_SQL, _AUC_SQL))
def q_roc_auc(spark, sf):
    """ML10: ROC AUC with tied scores averaged."""
    return rounded(metrics.roc_auc(scored(spark, sf), "target_binary", "proxy_prob"))


@register("pr_auc", _q(SCORED_SQL, f"""SELECT {R("a")} AS pr_auc FROM (
  SELECT CASE WHEN sum(pos) > 0 THEN sum(pos * (pos_upto / n_upto)) / sum(pos) ELSE 0.0 END AS a FROM (
    SELECT pos, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS pos_upto, sum(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS n_upto
    FROM (SELECT proxy_prob AS s, sum(CASE WHEN target_binary = 1 THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM scored GROUP BY 1) h) x) z"""))
def q_pr_auc(spark, sf):
    """ML1: area under the precision-recall curve (average precision), what boosting is stopped by."""
    return rounded(metrics.pr_auc(scored(spark, sf), "target_binary", "proxy_prob"))


def _class_sql(y: str, p: str, src: str = "scored", by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f""",
pairs AS (SELECT {b}{y} AS y, {p} AS p, count(*) AS c FROM {src} GROUP BY ALL),
cls AS (SELECT {b}class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, CAST(sum(support) AS BIGINT) AS support FROM (
  SELECT {b}y AS class, CASE WHEN y = p THEN c ELSE 0 END AS tp, 0 AS fp, CASE WHEN y <> p THEN c ELSE 0 END AS fn,
    c AS support FROM pairs
  UNION ALL SELECT {b}p, 0, CASE WHEN y <> p THEN c ELSE 0 END, 0, 0 FROM pairs) u GROUP BY ALL),
sc AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM cls) z)"""


@register("macro_metrics", _q(SCORED_SQL + _class_sql("target_multiclass", "proxy_class"),
                              f"SELECT {R('avg(pr)')} AS precision_macro, {R('avg(rc)')} AS recall_macro, "
                              f"{R('avg(f1)')} AS f1_macro FROM sc"))
def q_macro(spark, sf):
    """ML11: macro precision / recall / F1 over classes in truth or prediction."""
    return rounded(metrics.macro_metrics(scored(spark, sf), "target_multiclass", "proxy_class"))


@register("weighted_metrics", _q(SCORED_SQL + _class_sql("target_multiclass", "proxy_class"),
                                 "SELECT " + ", ".join(f"{R(f'sum({m} * support) / sum(support)')} AS {n}_weighted"
                                                       for m, n in [("pr", "precision"), ("rc", "recall"), ("f1", "f1")])
                                 + " FROM sc"))
def q_weighted(spark, sf):
    """ML12: support-weighted precision / recall / F1."""
    return rounded(metrics.weighted_metrics(scored(spark, sf), "target_multiclass", "proxy_class"))


@register("classification_report", _q(SCORED_SQL + _class_sql("target_binary", "proxy_pred"), f"""
SELECT CAST(class AS VARCHAR) AS label, {R('pr')} AS precision, {R('rc')} AS recall, {R('f1')} AS f1, support
FROM sc WHERE support > 0
UNION ALL SELECT 'accuracy', NULL, NULL, {R('avg(CASE WHEN target_binary = proxy_pred THEN 1.0 ELSE 0.0 END)')}, count(*) FROM scored
UNION ALL SELECT 'macro avg', {R('avg(pr)')}, {R('avg(rc)')}, {R('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM sc
UNION ALL SELECT 'weighted avg', {R('sum(pr * support) / sum(support)')}, {R('sum(rc * support) / sum(support)')},
  {R('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM sc"""))
def q_report(spark, sf):
    """ML13: per-class precision / recall / F1 / support plus summary rows."""
    return rounded(metrics.classification_report(scored(spark, sf), "target_binary", "proxy_pred"))


# -------------------------------------------------------- fold reports ---
FOLDED_SQL = SCORED_SQL + """,
positioned AS (SELECT *, row_number() OVER (ORDER BY inverter_id, datetime) - 1 AS row_pos,
  count(*) OVER () AS n_total FROM scored),
folded AS (SELECT *, CASE WHEN n_total // 6 > 0 AND row_pos >= n_total - 5 * (n_total // 6)
    THEN CAST((row_pos - (n_total - 5 * (n_total // 6))) // (n_total // 6) AS INTEGER) END AS test_fold,
  row_pos < floor(CAST(0.8 AS DOUBLE) * n_total) AS is_train FROM positioned),
tests AS (SELECT * FROM folded WHERE test_fold IS NOT NULL),
bin_cnt AS (SELECT test_fold, sum(CASE WHEN target_binary = 1 AND proxy_pred = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN target_binary <> 1 AND proxy_pred = 1 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN target_binary = 1 AND proxy_pred <> 1 THEN 1 ELSE 0 END) AS fn FROM tests GROUP BY 1),
bin_pr AS (SELECT test_fold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM bin_cnt),
hist AS (SELECT test_fold, proxy_prob AS s, sum(CASE WHEN target_binary = 1 THEN 1 ELSE 0 END) AS pos,
    sum(CASE WHEN target_binary <> 1 THEN 1 ELSE 0 END) AS neg FROM tests GROUP BY 1, 2),
auc AS (SELECT test_fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg))
    ELSE 0.0 END AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY test_fold ORDER BY s
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM hist) h GROUP BY 1)""" \
    + _class_sql("target_multiclass", "proxy_class", "tests", "test_fold") + """,
series AS (
  SELECT 'binary' AS task, test_fold + 1 AS fold, 'precision' AS metric, pr AS value FROM bin_pr
  UNION ALL SELECT 'binary', test_fold + 1, 'recall', rc FROM bin_pr
  UNION ALL SELECT 'binary', test_fold + 1, 'f1', CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END FROM bin_pr
  UNION ALL SELECT 'binary', test_fold + 1, 'auc', auc FROM auc
  UNION ALL SELECT 'multiclass', test_fold + 1, 'precision_macro', avg(pr) FROM sc GROUP BY test_fold
  UNION ALL SELECT 'multiclass', test_fold + 1, 'recall_macro', avg(rc) FROM sc GROUP BY test_fold
  UNION ALL SELECT 'multiclass', test_fold + 1, 'f1_macro', avg(f1) FROM sc GROUP BY test_fold)"""


def fold_series_df(spark, sf) -> DataFrame:
    """Per walk-forward test fold: binary P/R/F1/AUC and multiclass macro P/R/F1 (long form)."""
    f = materialize(folds.walk_forward_folds(scored(spark, sf)).where(F.col("test_fold").isNotNull()))
    b = metrics.binary_metrics(f, "target_binary", "proxy_pred", by=["test_fold"]) \
        .join(metrics.roc_auc(f, "target_binary", "proxy_prob", by=["test_fold"]), "test_fold")
    m = metrics.macro_metrics(f, "target_multiclass", "proxy_class", by=["test_fold"])
    bl = metrics.to_long(b, ["test_fold"], ["precision", "recall", "f1", "auc"]).withColumn("task", F.lit("binary"))
    ml = metrics.to_long(m, ["test_fold"], ["precision_macro", "recall_macro", "f1_macro"]).withColumn("task", F.lit("multiclass"))
    return bl.unionByName(ml).select("task", (F.col("test_fold") + 1).alias("fold"), "metric", "value")


@register("fold_series", _q(FOLDED_SQL, f"SELECT task, fold, metric, {R('value')} AS value FROM series"))
def q_fold_series(spark, sf):
    """RP2: per-fold metric series, long form."""
    return rounded(fold_series_df(spark, sf))


@register("fold_aggregate", _q(FOLDED_SQL, f"SELECT task, metric, {R('avg(value)')} AS mean, "
                                           f"{R('stddev_pop(value)')} AS std FROM series GROUP BY 1, 2"))
def q_fold_aggregate(spark, sf):
    """AG10: mean and population std of each metric over the folds."""
    return rounded(metrics.fold_aggregate(fold_series_df(spark, sf)))


def model_performance_df(spark, sf) -> DataFrame:
    agg = metrics.fold_aggregate(fold_series_df(spark, sf))
    cv = agg.select(F.concat(F.col("task"), F.lit("_cv")).alias("section"), "metric", "mean", "std")
    s = materialize(folds.holdout_split(scored(spark, sf)).where(~F.col("is_train")))
    hb = metrics.binary_with_auc(s, "target_binary", "proxy_pred", "proxy_prob")
    ho = metrics.to_long(hb, [], ["precision", "recall", "f1", "auc"]).select(
        F.lit("holdout_binary").alias("section"), "metric", F.col("value").alias("mean"),
        F.lit(None).cast("double").alias("std"))
    return cv.unionByName(ho)


@register("model_performance", _q(FOLDED_SQL + """,
ho AS (SELECT * FROM folded WHERE NOT is_train),
ho_cnt AS (SELECT sum(CASE WHEN target_binary = 1 AND proxy_pred = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN target_binary <> 1 AND proxy_pred = 1 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN target_binary = 1 AND proxy_pred <> 1 THEN 1 ELSE 0 END) AS fn FROM ho),
ho_pr AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM ho_cnt),
ho_h AS (SELECT proxy_prob AS s, sum(CASE WHEN target_binary = 1 THEN 1 ELSE 0 END) AS pos,
    sum(CASE WHEN target_binary <> 1 THEN 1 ELSE 0 END) AS neg FROM ho GROUP BY 1),
ho_auc AS (SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg))
    ELSE 0.0 END AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS nb FROM ho_h) h)""", f"""
SELECT task || '_cv' AS section, metric, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std FROM series GROUP BY 1, 2
UNION ALL SELECT 'holdout_binary', 'precision', {R('pr')}, NULL FROM ho_pr
UNION ALL SELECT 'holdout_binary', 'recall', {R('rc')}, NULL FROM ho_pr
UNION ALL SELECT 'holdout_binary', 'f1', {R('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END')}, NULL FROM ho_pr
UNION ALL SELECT 'holdout_binary', 'auc', {R('auc')}, NULL FROM ho_auc"""))
def q_model_performance(spark, sf):
    """RP1: CV aggregates per task plus hold-out binary metrics."""
    return rounded(model_performance_df(spark, sf))


# --------------------------------------------------------- risk board ---
_DISPLAY_SQL = "CASE {c} " + " ".join(f"WHEN {k} THEN {_lit(v)}" for k, v in RISK_DISPLAY.items()) + " ELSE 'unknown' END"


def _latest_scored(spark, sf):
    return ranking.latest_per_entity(scored(spark, sf))


@register("risk_board", _q(SCORED_SQL + _LATEST_SQL, f"""SELECT inverter_id, plant_id, proxy_prob AS failure_prob,
  printf('%.2f%%', proxy_prob * 100) AS failure_prob_text, proxy_class AS risk_class,
  {_DISPLAY_SQL.format(c='proxy_class')} AS risk_label FROM latest"""))
def q_risk_board(spark, sf):
    """RP3 + SK3: latest reading per inverter, scored, as the full risk table."""
    lt = _latest_scored(spark, sf)
    return lt.select("inverter_id", "plant_id", F.col("proxy_prob").alias("failure_prob"),
                     risk.percent(F.col("proxy_prob")).alias("failure_prob_text"),
                     F.col("proxy_class").alias("risk_class"),
                     risk.risk_display(F.col("proxy_class")).alias("risk_label")).orderBy(F.desc("failure_prob"), "inverter_id")


@register("risk_distribution", _q(SCORED_SQL + _LATEST_SQL, """SELECT k.class AS risk_class,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_inverters
FROM (VALUES (0), (1), (2)) k(class) LEFT JOIN (SELECT proxy_class, count(*) AS n FROM latest GROUP BY 1) c
  ON c.proxy_class = k.class"""))
def q_risk_distribution(spark, sf):
    """AG9: inverters per risk class, classes 0-2 always present."""
    counts = _latest_scored(spark, sf).groupBy(F.col("proxy_class").alias("risk_class")).agg(
        F.count(F.lit(1)).alias("n"))
    classes = spark.range(3).select(F.col("id").cast("int").alias("risk_class"))
    return classes.join(counts, "risk_class", "left").select(
        "risk_class", F.coalesce("n", F.lit(0)).cast("long").alias("n_inverters"))


@register("top_risky", _q(SCORED_SQL + _LATEST_SQL, """SELECT inverter_id, proxy_prob AS failure_prob,
  proxy_class AS risk_class FROM latest ORDER BY proxy_prob DESC, inverter_id LIMIT 15"""))
def q_top_risky(spark, sf):
    """SK2: the 15 inverters with the highest failure probability."""
    lt = _latest_scored(spark, sf).select("inverter_id", F.col("proxy_prob").alias("failure_prob"),
                                          F.col("proxy_class").alias("risk_class"))
    return ranking.top_k(lt, 15, [F.desc("failure_prob"), F.asc("inverter_id")])


@register("risk_trend", _q(SCORED_SQL, f"""SELECT inverter_id, datetime, CAST(n - 1 - rd AS INTEGER) AS reading_no,
  proxy_prob AS failure_prob, {_DISPLAY_SQL.format(c='proxy_class')} AS risk_label
FROM (SELECT *, row_number() OVER (PARTITION BY inverter_id ORDER BY datetime DESC) - 1 AS rd,
  least(count(*) OVER (PARTITION BY inverter_id), 10) AS n FROM scored) x WHERE rd < 10"""))
def q_risk_trend(spark, sf):
    """RP4: failure probability over each inverter's last 10 readings."""
    s = scored(spark, sf).select(*KEYS, "proxy_prob", "proxy_class")
    last = ranking.last_n_per_entity(s, 10)
    return last.select(*KEYS, "reading_no", F.col("proxy_prob").alias("failure_prob"),
                       risk.risk_display(F.col("proxy_class")).alias("risk_label"))


# -------------------------------------------------------- attribution ---
def attributions(spark, sf) -> dict[str, tuple[Column, Column]]:
    """(value, impact) expressions of each key feature over the featured table: deviation from
    its healthy median, scaled by (|median| + 1), rounded to 6 places."""
    medians = {r.feature: r.median for r in baseline_table(spark, sf).collect()}  # one row per feature
    found = {}
    for c in AVAILABLE_KEYS:
        if c in medians:
            value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            m = F.lit(medians[c]).cast("double")
            found[c] = value, round6((value - m) / (F.abs(m) + 1))
    return found


def top_drivers(spark, sf, k: int) -> Column:
    """SK5: the row's ``k`` features of largest |impact| as an array, best first: no explosion, no shuffle."""
    parts = [F.struct((-F.abs(impact)).alias("order"), F.lit(c).alias("feature"), value.alias("value"), impact.alias("impact"))
             for c, (value, impact) in attributions(spark, sf).items()]
    return F.slice(F.array_sort(F.array(*parts)), 1, k)


def global_attribution(spark, sf) -> DataFrame:
    """SK4: (feature, m): mean |impact| of each feature, all in one pass over the featured table."""
    att = attributions(spark, sf)
    means = featured(spark, sf).agg(*[F.avg(F.abs(impact)).alias(c) for c, (_, impact) in att.items()])
    return matrix.unpivot(means, [], list(att)).select("feature", F.col("value").alias("m"))


ATTR_SQL = FEATURED_SQL + BASELINE_SQL + """,
pos AS (SELECT *, row_number() OVER (ORDER BY inverter_id, datetime) - 1 AS row_id FROM featured),
attr AS (SELECT u.row_id, u.feature, u.value, """ + R("(u.value - b.median) / (abs(b.median) + 1)") + """ AS impact
  FROM (UNPIVOT (SELECT row_id, """ + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in AVAILABLE_KEYS) \
    + " FROM pos) ON " + ", ".join(AVAILABLE_KEYS) + """ INTO NAME feature VALUE value) u
  JOIN baseline b ON b.feature = u.feature)"""


@register("topk_attribution_global", _q(ATTR_SQL, f"""SELECT CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank,
  feature, {R('m')} AS mean_abs_impact FROM (SELECT feature, avg(abs(impact)) AS m FROM attr GROUP BY 1) g
  ORDER BY m DESC, feature LIMIT 10"""))
def q_topk_global(spark, sf):
    """SK4 / ML14: top-10 features by mean absolute attribution."""
    g = global_attribution(spark, sf).withColumnRenamed("m", "mean_abs_impact")
    # one row per feature: ranking the feature table is bounded by the feature count
    ranked = g.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("mean_abs_impact"), F.asc("feature"))).cast("int"))
    return rounded(ranked.where(F.col("rank") <= 10).select("rank", "feature", "mean_abs_impact"))


@register("topk_attribution_row", _q(ATTR_SQL, f"""SELECT row_id, CAST(rk AS INTEGER) AS rank, feature, {R('value')} AS value,
  {R('impact')} AS impact, CASE WHEN impact > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(impact) DESC, feature) AS rk FROM attr) x
WHERE rk <= 5"""))
def q_topk_row(spark, sf):
    """SK5 + FN14 / ML15: per-row top-5 drivers with direction; a row is named by its position in the whole table."""
    f = ranking.global_positions(featured(spark, sf), out="row_id")
    t = f.select("row_id", F.posexplode(top_drivers(spark, sf, 5)).alias("rank", "d"))
    return rounded(t.select("row_id", (F.col("rank") + 1).cast("int").alias("rank"), "d.feature", "d.value", "d.impact",
                            risk.direction(F.col("d.impact")).alias("direction")))


@register("feature_catalogue", _q(FEATURED_SQL + BASELINE_SQL, f"""SELECT k.position, k.feature, {R('b.median')} AS baseline,
  array_to_string(list_transform(string_split(replace(k.feature, '_', ' '), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS display_name
FROM (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(KEY_FEATURES))}) k(position, feature)
LEFT JOIN baseline b ON b.feature = k.feature"""))
def q_feature_catalogue(spark, sf):
    """RP5 + FN17: model feature list in order with healthy baseline values and display names."""
    base = baseline_table(spark, sf)
    cat = spark.createDataFrame([(i, f) for i, f in enumerate(KEY_FEATURES)], "position int, feature string")
    return rounded(cat.join(F.broadcast(base), "feature", "left").select(
        "position", "feature", F.col("median").alias("baseline"),
        risk.pretty_feature(F.col("feature")).alias("display_name")))


# ------------------------------------------------------------ serving ---
def serving_inputs(spark, sf):
    feat = featured(spark, sf)
    return serving.readings_from_featured(feat), baseline_table(spark, sf)


def _given_sql(f: str) -> str:
    """SQL statement of which keys a derived sparse reading carries (see readings_from_featured)."""
    always = {"inv_temp", "meter_pf", "meter_freq", "meter_v_r", "meter_v_y", "meter_v_b",
              "smu_num_zero", "smu_total_strings", "ambient_temp"}
    cond = {"inv_power": "inverter_idx % 2 = 0", "alarm_count_7d": "inverter_idx % 3 = 0",
            "alarm_count_24h": "inverter_idx % 5 = 0", "hour": "is_daytime = 0"}
    if f in always:
        return f"{f} IS NOT NULL"
    if f in cond:
        return f"({cond[f]} AND {f} IS NOT NULL)"
    return "FALSE"


def _serve_sql() -> str:
    def g(f):
        return _given_sql(f)

    def v(f):
        return f"CAST({f} AS DOUBLE)" if f in {"inv_temp", "meter_pf", "meter_freq", "meter_v_r", "meter_v_y",
                                                "meter_v_b", "smu_num_zero", "smu_total_strings", "ambient_temp",
                                                "inv_power", "alarm_count_7d", "alarm_count_24h", "hour"} else "NULL"

    def b(f):
        return f"(SELECT median FROM baseline WHERE feature = '{f}')"
    row = {f: f"coalesce(CASE WHEN {g(f)} THEN {v(f)} END, {b(f)}, 0.0)" for f in KEY_FEATURES}
    row["hour"] = f"CASE WHEN {g('hour')} THEN {v('hour')} ELSE CAST(hour(datetime) AS DOUBLE) END"
    row["month"] = "CAST(month(datetime) AS DOUBLE)"
    row["is_daytime"] = f"CASE WHEN ({row['hour']}) BETWEEN 6 AND 18 THEN 1.0 ELSE 0.0 END"
    a = "CAST(alarm_count_7d AS DOUBLE)"
    row["alarm_count_24h"] = (f"CASE WHEN {g('alarm_count_7d')} AND NOT {g('alarm_count_24h')} THEN least({a}, {a} / 7.0) "
                              f"ELSE {row['alarm_count_24h']} END")
    row["hours_since_last_alarm"] = (f"CASE WHEN {g('alarm_count_7d')} AND {a} > 0 THEN greatest(1.0, 168.0 / ({a} + 1)) "
                                     f"WHEN {g('alarm_count_7d')} THEN 9999.0 ELSE {row['hours_since_last_alarm']} END")
    vr, vy, vb = row["meter_v_r"], row["meter_v_y"], row["meter_v_b"]
    mean = f"(({vr}) + ({vy}) + ({vb})) / 3.0"
    row["voltage_imbalance"] = (f"(greatest({vr}, {vy}, {vb}) - least({vr}, {vy}, {vb})) / "
                                f"(CASE WHEN {mean} > 0 THEN {mean} ELSE 1.0 END)")
    row["pf_deviation"] = f"abs(1.0 - ({row['meter_pf']}))"
    row["freq_deviation"] = f"abs(({row['meter_freq']}) - 50.0)"
    row["power_ratio_vs_24h"] = (f"CASE WHEN {g('inv_power')} THEN CAST(inv_power AS DOUBLE) / "
                                 f"(coalesce({b('inv_power')}, 1.0) + 0.01) ELSE {row['power_ratio_vs_24h']} END")
    tot, zero = row["smu_total_strings"], row["smu_num_zero"]
    row["smu_zero_fraction"] = f"CASE WHEN ({tot}) > 0 THEN ({zero}) / ({tot}) ELSE {row['smu_zero_fraction']} END"
    rid = "inverter_id || '|' || strftime(datetime, '%Y-%m-%d %H')"
    return (FEATURED_SQL + BASELINE_SQL + f"\nSELECT {rid} AS reading_id, inverter_id, "
            + ", ".join(f"{R(row[f])} AS {f}" for f in KEY_FEATURES) + " FROM featured")


@register("serve_complete", _serve_sql())
def q_serve_complete(spark, sf):
    """SV1-SV7: sparse readings completed over the healthy baseline with serving-side rules."""
    readings, base = serving_inputs(spark, sf)
    return rounded(serving.complete_readings(readings, base))


@register("manual_entry", FEATURED_SQL + "\nSELECT inverter_id || '|' || strftime(datetime, '%Y-%m-%d %H') AS reading_id, "
          "inverter_id, " + ", ".join(
              (f"{R(f'coalesce(CASE WHEN {_given_sql(f)} THEN CAST({f} AS DOUBLE) END, 0.0)')} AS {f}"
           if f in AVAILABLE_KEYS else f"0.0 AS {f}") for f in KEY_FEATURES) + " FROM featured")
def q_manual_entry(spark, sf):
    """SV8: manual-entry completion (unspecified features 0.0, no derived rules)."""
    readings, _ = serving_inputs(spark, sf)
    return rounded(serving.complete_readings(readings, None, defaults="zero"))


# --------------------------------------------------------------- text ---
def _contains_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {_lit(w)})" for w in words) + ")"


_INTENT_SQL = (f"CASE WHEN {_contains_sql(text.CAUSE_WORDS)} THEN 'cause' "
               f"WHEN {_contains_sql(text.ACTION_WORDS)} THEN 'maintenance' ELSE 'help' END")


@register("intent_routing", f"""SELECT conv_id, turn, intent,
  CASE intent WHEN 'cause' THEN {_lit(text.CAUSE_ANSWER)} WHEN 'maintenance' THEN {_lit(text.ACTION_ANSWER)}
    ELSE {_lit(text.HELP_ANSWER)} END AS answer
FROM (SELECT *, {_INTENT_SQL} AS intent FROM conversations WHERE role = 'user') m""")
def q_intent_routing(spark, sf):
    """TX1: ordered substring rules route each user message to an answer."""
    m = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"]).where(F.col("role") == "user")
    intent = text.route_intent(F.col("text"))
    return m.select("conv_id", "turn", intent.alias("intent"), text.intent_answer(intent).alias("answer"))


_TOPIC_SQL = (f"CASE WHEN {_contains_sql(text.FEATURE_WORDS)} THEN 'features' "
              f"WHEN {_contains_sql(text.PERFORMANCE_WORDS)} THEN 'performance' "
              f"WHEN {_contains_sql(text.RISK_WORDS)} THEN 'risk' ELSE 'default' END")


_FALLBACK_SQL = (FOLDED_SQL + ATTR_SQL[len(FEATURED_SQL):] + f"""
SELECT m.conv_id, m.turn, m.topic,
  CASE m.topic WHEN 'features' THEN printf({_lit(text.FEATURE_ANSWER)}, tf.feats)
    WHEN 'performance' THEN printf({_lit(text.PERFORMANCE_ANSWER)}, cv.f1, cv.auc, cv.prec)
    WHEN 'risk' THEN {_lit(text.RISK_ANSWER)} ELSE {_lit(text.DEFAULT_ANSWER)} END AS answer
FROM (SELECT conv_id, turn, {_TOPIC_SQL} AS topic FROM conversations WHERE role = 'user') m,
  (SELECT string_agg(feature, ', ' ORDER BY rk) AS feats FROM (
     SELECT feature, row_number() OVER (ORDER BY mi DESC, feature) AS rk
     FROM (SELECT feature, avg(abs(impact)) AS mi FROM attr GROUP BY 1) g) r WHERE rk <= 5) tf,
  (SELECT avg(value) FILTER (WHERE metric = 'f1') AS f1, avg(value) FILTER (WHERE metric = 'auc') AS auc,
     avg(value) FILTER (WHERE metric = 'precision') AS prec FROM series WHERE task = 'binary') cv""")


@register("fallback_answers", _FALLBACK_SQL)
def q_fallback_answers(spark, sf):
    """TX2: topic rules; answers interpolate the top-5 attribution features and CV means."""
    ranked = global_attribution(spark, sf).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("m"), F.asc("feature"))))
    feats = ranked.where(F.col("rk") <= 10).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "feature"))), lambda s: s["feature"]).alias("top"))
    agg = metrics.fold_aggregate(fold_series_df(spark, sf)).where(F.col("task") == "binary")
    cv = agg.groupBy().pivot("metric", ["f1", "auc", "precision"]).agg(F.first("mean"))
    msgs = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"]).where(F.col("role") == "user")
    topic = text.route_topic(F.col("text"))
    # both context tables have exactly one row: their values enter the plan as literals
    top5 = feats.first()["top"]
    m = cv.first()
    return msgs.select("conv_id", "turn", topic.alias("topic"), text.topic_answer(
        topic, F.array(*[F.lit(x) for x in top5]).cast("array<string>"),
        F.lit(m["f1"]).cast("double"), F.lit(m["auc"]).cast("double"),
        F.lit(m["precision"]).cast("double")).alias("answer"))


@register("prompt_column", f"""SELECT conv_id, turn,
  'Context data:' || chr(10) || '```json' || chr(10) || printf('{{' || chr(10) || '  "conv_id": %d,' || chr(10)
    || '  "turn": %d' || chr(10) || '}}', conv_id, turn) || chr(10) || '```' || chr(10) || chr(10)
    || 'User question: ' || text AS prompt
FROM conversations WHERE role = 'user'""")
def q_prompt_column(spark, sf):
    """TX4: prompt text = JSON context block + question, per user message."""
    m = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"]).where(F.col("role") == "user")
    context = F.create_map(F.lit("conv_id"), F.col("conv_id").cast("long"), F.lit("turn"), F.col("turn").cast("long"))
    return m.select("conv_id", "turn", text.prompt_text(text.context_json(context), F.col("text")).alias("prompt"))


@register("prompt_reading_context", _q(SCORED_SQL + _LATEST_SQL, """SELECT inverter_id,
  'Context data:' || chr(10) || '```json' || chr(10) || printf('{' || chr(10) || '  "hour": %d,' || chr(10)
    || '  "alarm_count_7d": %d,' || chr(10) || '  "risk_class": %d,' || chr(10) || '  "inverter_id": "%s"' || chr(10) || '}',
    hour, CAST(alarm_count_7d AS BIGINT), proxy_class, inverter_id) || chr(10) || '```' || chr(10) || chr(10)
    || 'User question: Why is this inverter at risk?' AS prompt
FROM latest"""))
def q_prompt_reading_context(spark, sf):
    """TX4: the question about each inverter's latest reading, its values and id as context."""
    values = {"hour": "hour", "alarm_count_7d": "alarm_count_7d", "risk_class": "proxy_class"}
    context = F.create_map(*[x for k, c in values.items() for x in (F.lit(k), F.col(c).cast("long"))])
    return _latest_scored(spark, sf).select("inverter_id", text.prompt_text(
        text.context_json(context, F.col("inverter_id")), F.lit("Why is this inverter at risk?")).alias("prompt"))


@register("prediction_summary", _q(ATTR_SQL + """,
scoredf AS (SELECT *, CAST(((CAST(inverter_idx AS BIGINT) * 37 + hour * 11 + day_of_week * 5
      + CAST(alarm_count_7d AS BIGINT) * 13) % 1000) AS DOUBLE) / 1000.0 AS proxy_prob,
    CAST((inverter_idx + hour + CAST(alarm_count_24h AS INTEGER)) % 3 AS INTEGER) AS proxy_class FROM pos),
lastrow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inverter_id ORDER BY datetime DESC) AS rn
  FROM scoredf) x WHERE rn = 1),
drivers AS (SELECT row_id, string_agg(feature || ' (' || CASE WHEN impact > 0 THEN 'increases risk'
    ELSE 'decreases risk' END || ')', ', ' ORDER BY rk) AS d
  FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(impact) DESC, feature) AS rk FROM attr) a
  WHERE rk <= 3 GROUP BY 1)""", """SELECT l.inverter_id,
  '**Inverter ' || l.inverter_id || '** — ' ||
  CASE l.proxy_class WHEN 0 THEN 'Operating normally (failure probability: ' || printf('%.1f%%', l.proxy_prob * 100) || '). '
    WHEN 1 THEN '⚠️ Degradation risk detected (failure probability: ' || printf('%.1f%%', l.proxy_prob * 100) || '). '
    ELSE '\U0001f6a8 HIGH SHUTDOWN RISK (failure probability: ' || printf('%.1f%%', l.proxy_prob * 100) || '). ' END ||
  CASE WHEN d.d IS NULL THEN '' ELSE 'Key drivers: ' || d.d || '.' END ||
  CASE WHEN l.alarm_count_7d > 0 THEN ' ⚠️ Anomalous behavior detected by Isolation Forest.' ELSE '' END AS summary
FROM lastrow l LEFT JOIN drivers d ON d.row_id = l.row_id"""))
def q_prediction_summary(spark, sf):
    """TX3: one summary sentence per inverter's latest scored reading with its top-3 drivers."""
    latest = ranking.latest_per_entity(risk.proxy_score(featured(spark, sf)))  # before any attribution
    lvl = risk.risk_level(F.col("proxy_class"))
    fac = F.transform(top_drivers(spark, sf, 3), lambda d: F.struct(d["feature"].alias("feature"), risk.direction(d["impact"]).alias("direction")))
    j = latest
    return j.select("inverter_id", text.prediction_summary(F.col("inverter_id"), lvl, F.col("proxy_prob"), fac,
                                                           F.col("alarm_count_7d") > 0).alias("summary"))


# ----------------------------------------------------- loader pieces ---
_NUM_TEXT_SQL = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def _to_double_sql(s: str) -> str:
    return (f"CASE WHEN regexp_matches({s}, '{_NUM_TEXT_SQL}') THEN "
            f"(CASE WHEN isnan(TRY_CAST(trim({s}) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim({s}) AS DOUBLE) END) END")


_TEXT_FORMS_SQL = """SELECT event_id, CAST(value AS VARCHAR) AS t_value, props AS t_props,
  regexp_extract(props, '([0-9]+)', 1) AS t_digits,
  CASE event_type WHEN 'error' THEN 'nan' WHEN 'click' THEN '-inf' WHEN 'view' THEN CAST(value AS VARCHAR) || 'd'
    ELSE ' ' || CAST(value AS VARCHAR) || ' ' END AS t_mixed FROM events"""


@register("numeric_coercion", f"""SELECT event_id, {_to_double_sql('t_value')} AS n_value, {_to_double_sql('t_props')} AS n_props,
  {_to_double_sql('t_digits')} AS n_digits, {_to_double_sql('t_mixed')} AS n_mixed FROM ({_TEXT_FORMS_SQL}) t""")
def q_numeric_coercion(spark, sf):
    """PRJ2: lenient text -> double (bad text and NaN -> NULL, 'inf' kept) over text forms of events."""
    e = read_table(spark, sf, "events", ["event_id", "value", "props", "event_type"])
    v = F.col("value").cast("string")
    mixed = (F.when(F.col("event_type") == "error", "nan").when(F.col("event_type") == "click", "-inf")
             .when(F.col("event_type") == "view", F.concat(v, F.lit("d"))).otherwise(F.concat(F.lit(" "), v, F.lit(" "))))
    return e.select("event_id", to_double(v).alias("n_value"), to_double(F.col("props")).alias("n_props"),
                    to_double(F.regexp_extract("props", "([0-9]+)", 1)).alias("n_digits"), to_double(mixed).alias("n_mixed"))


@register("timestamp_parse", """SELECT event_id, parsed_text, parsed_epoch FROM (
  SELECT event_id,
    try_strptime(CASE WHEN event_type = 'error' THEN 'not a time' WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
      WHEN event_id % 4 = 1 THEN strftime(ts, '%m/%d/%Y %H:%M:%S') WHEN event_id % 4 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
      ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END,
      ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S.%fZ', '%m/%d/%Y %H:%M:%S', '%d/%m/%Y %H:%M:%S']) AS parsed_text,
    make_timestamp((epoch_us(ts) // 1000) * 1000) AS parsed_epoch FROM events) t
WHERE parsed_text IS NOT NULL""")
def q_timestamp_parse(spark, sf):
    """SRC4: ISO, zoned, month-first and day-first texts / epoch milliseconds; unparsable rows dropped."""
    e = read_table(spark, sf, "events", ["event_id", "ts", "event_type"])
    kind = F.col("event_id") % 4
    txt = (F.when(F.col("event_type") == "error", F.lit("not a time"))
           .when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(kind == 1, F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
           .when(kind == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
           .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")))
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    out = e.select("event_id", parse_text_timestamp(txt).alias("parsed_text"), parse_epoch_millis(ms).alias("parsed_epoch"))
    return out.where(F.col("parsed_text").isNotNull())


def wide_from_events(spark, sf) -> DataFrame:
    """A wide per-logger frame derived from events: 4 inverter blocks + 2 SMU blocks per row."""
    e = read_table(spark, sf, "events", ["event_id", "ts", "value"])
    cols = [F.col("event_id").cast("string").alias("timestamp_id"),
            F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
            (F.col("event_id") % 30 + 10).cast("string").alias("sensors[0].ambient_temp"),
            (F.col("event_id") % 7 + 46).cast("string").alias("meters[0].freq")]
    for i in range(4):
        cols.append((F.col("value") * (i + 1)).cast("string").alias(f"inverters[{i}].power"))
        cols.append(((F.col("event_id") + i) % 50).cast("string").alias(f"inverters[{i}].temp"))
    for i in range(2):
        for s in (1, 2):
            cols.append(F.when((F.col("event_id") + s + i) % 4 == 0, F.lit("0"))
                        .otherwise((F.col("value") / (s + i)).cast("string")).alias(f"smu[{i}].string{s}"))
    return e.select(*cols)


@register("unpivot_inverters", """SELECT CAST(timestamp_id AS BIGINT) AS event_id, inverter_idx, """ + R("inv_power") + """ AS inv_power,
  """ + R("inv_temp") + """ AS inv_temp, """ + R("smu_string_mean") + """ AS smu_string_mean, smu_total_strings, ambient_temp, meter_freq FROM (
  SELECT CAST(event_id % 30 + 10 AS DOUBLE) AS ambient_temp, CAST(event_id % 7 + 46 AS DOUBLE) AS meter_freq, CAST(event_id AS VARCHAR) AS timestamp_id, i AS inverter_idx, value * (i + 1) AS inv_power,
    CAST((event_id + i) % 50 AS DOUBLE) AS inv_temp,
    (CASE WHEN (event_id + 1 + si) % 4 = 0 THEN 0.0 ELSE value / (1 + si) END
      + CASE WHEN (event_id + 2 + si) % 4 = 0 THEN 0.0 ELSE value / (2 + si) END) / 2.0 AS smu_string_mean,
    2.0 AS smu_total_strings
  FROM events, (SELECT i, CASE WHEN i = 1 THEN 1 ELSE 0 END AS si FROM range(4) r(i)) b) u""")
def q_unpivot_inverters(spark, sf):
    """PRJ1 + PRJ3 + PRJ4 + PRJ5: wide inverter blocks -> rows in one pass; inverters without own SMU use smu[0], shared blocks get their prefix."""
    wide = wide_from_events(spark, sf)
    long = unpivot_inverters(wide, "Plant_1", F.lit("L0"), carry=["timestamp_id"])
    return rounded(long.select(F.col("timestamp_id").cast("long").alias("event_id"), "inverter_idx", "inv_power",
                               "inv_temp", "smu_string_mean", "smu_total_strings", "ambient_temp", "meter_freq"))


@register("csv_readings", """SELECT inverter_id, inverter_idx, """ + R("inv_power") + """ AS inv_power, """ + R("inv_temp") + """ AS inv_temp,
  """ + R("smu_string_mean") + """ AS smu_string_mean, smu_total_strings, ambient_temp, meter_freq, datetime FROM (
  SELECT 'Plant_' || (event_id % 3 + 1) || '_MAC' || (event_id % 3 + 1) || '_INV' || i AS inverter_id, i AS inverter_idx, value * (i + 1) AS inv_power,
    CAST((event_id + i) % 50 AS DOUBLE) AS inv_temp, CAST(event_id % 30 + 10 AS DOUBLE) AS ambient_temp, CAST(event_id % 7 + 46 AS DOUBLE) AS meter_freq,
    (CASE WHEN (event_id + 1 + si) % 4 = 0 THEN 0.0 ELSE value / (1 + si) END
      + CASE WHEN (event_id + 2 + si) % 4 = 0 THEN 0.0 ELSE value / (2 + si) END) / 2.0 AS smu_string_mean,
    2.0 AS smu_total_strings, date_trunc('milliseconds', ts) AS datetime
  FROM events, (SELECT i, CASE WHEN i = 1 THEN 1 ELSE 0 END AS si FROM range(4) r(i)) b) u""")
def q_csv_readings(spark, sf):
    """SRC1 + SRC2 + SRC4 + SRC5 + PRJ1: the events as wide CSV files of three plants, read back by the data source."""
    import uuid

    from ..session import scratch_path
    from ..sources.telemetry_source import load_readings
    root = scratch_path(spark, f"csv/{uuid.uuid4().hex}")
    wide = wide_from_events(spark, sf).withColumn("plant", F.col("timestamp_id").cast("long") % 3 + 1)
    for p in (1, 2, 3):
        (wide.where(F.col("plant") == p).drop("plant").withColumn("mac", F.lit(f"MAC{p}")).write.option("header", True).csv(f"{root}/Plant {p}"))
    return rounded(load_readings(spark, root).select("inverter_id", "inverter_idx", "inv_power", "inv_temp", "smu_string_mean", "smu_total_strings",
                                                     "ambient_temp", "meter_freq", "datetime"))


@register("union_by_name", """SELECT * FROM (
  SELECT event_id, value AS inv_power FROM events WHERE event_type = 'error'
  UNION ALL BY NAME
  SELECT event_id, ts AS datetime, value AS inv_temp FROM events WHERE event_type <> 'error')""")
def q_union_by_name(spark, sf):
    """SO1: frames with different columns combined by name, missing columns NULL."""
    e = read_table(spark, sf, "events", ["event_id", "ts", "value", "event_type"])
    a = e.where(F.col("event_type") == "error").select("event_id", F.col("value").alias("inv_power"))
    b = e.where(F.col("event_type") != "error").select("event_id", F.col("ts").alias("datetime"),
                                                        F.col("value").alias("inv_temp"))
    return a.unionByName(b, allowMissingColumns=True)
