"""Registered queries: matrix, baseline, splits, metrics, ranking, risk reports, serving, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, matrix, ranking, risk, sketches
from ..schema import EXCLUDE_COLS, KEY_FEATURES, RISK_RECOMMENDATIONS
from ..session import materialize
from . import sql_twins as S
from .catalog import register, rounded, sql_round6
from .feature_queries import FEATURED_COLS, KEYS
from .store import featured_store_path, featured_table

INT_COLS = {"inverter_idx", "hour", "day_of_week", "month", "is_daytime", "alarm_active",
            "target_binary", "target_multiclass"}
MATRIX_COLS = [c for c in FEATURED_COLS if c not in set(EXCLUDE_COLS)]
AVAILABLE_KEYS = [f for f in KEY_FEATURES if f in set(FEATURED_COLS)]
ABSENT_KEYS = [f for f in KEY_FEATURES if f not in set(FEATURED_COLS)]

FEATURED_SQL = S.base_featured(7)
SCORED_SQL = FEATURED_SQL + "," + risk.PROXY_SQL


def _q(base: str, body: str) -> str:
    return f"{base}\n{body}"


def featured(spark, sf):
    """The stored featured table (SRC6/SRC7): built once per source snapshot, then read."""
    return featured_table(spark, sf)


def scored(spark, sf):
    return risk.proxy_score(featured(spark, sf))


# ------------------------------------------------------------- matrix ---
def _clean_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE CAST({c} AS DOUBLE) END"


@register("feature_matrix_clean", _q(FEATURED_SQL, "SELECT inverter_id, datetime, "
                                     + ", ".join(f"{sql_round6(_clean_sql(c))} AS {c}" for c in MATRIX_COLS)
                                     + " FROM featured"))
def q_feature_matrix(spark, sf):
    """PRJ8 + PRJ9: numeric features minus ids/leaks, NULL/NaN/inf -> 0."""
    return rounded(matrix.feature_matrix(featured(spark, sf), keep=KEYS))


@register("key_feature_select", _q(FEATURED_SQL, "SELECT inverter_id, datetime, "
                                   + ", ".join(f"{sql_round6(f'coalesce(CAST({c} AS DOUBLE), 0.0)')} AS {c}"
                                               for c in AVAILABLE_KEYS)
                                   + ", target_binary, target_multiclass FROM featured"))
def q_key_feature_select(spark, sf):
    """PRJ10 + PRJ7: available key features, NULL -> 0, non-null targets."""
    return rounded(matrix.key_feature_frame(featured(spark, sf), keep=KEYS))


_LATEST_SQL = """,
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inverter_id ORDER BY datetime DESC) AS rn FROM scored) x
  WHERE rn = 1
)"""


@register("pad_features", _q(SCORED_SQL + _LATEST_SQL, "SELECT inverter_id, "
                             + ", ".join(f"{sql_round6(_clean_sql(c))} AS {c}" if c in AVAILABLE_KEYS else f"0.0 AS {c}"
                                         for c in KEY_FEATURES) + " FROM latest"))
def q_pad_features(spark, sf):
    """PRJ11: latest rows in exact model column order, absent features 0.0."""
    latest = ranking.latest_per_entity(featured(spark, sf))
    return rounded(matrix.pad_to_model(latest, KEY_FEATURES, keep=["inverter_id"]))


_COVERAGE_VALUES = ", ".join(f"({i}, '{f}')" for i, f in enumerate(KEY_FEATURES))
_COVERAGE_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n FROM featured" for c in AVAILABLE_KEYS)


@register("feature_coverage", _q(FEATURED_SQL, f"""SELECT k.position, k.feature, c.n IS NOT NULL AS available,
  CAST(coalesce(c.n, 0) AS BIGINT) AS non_null
FROM (VALUES {_COVERAGE_VALUES}) k(position, feature) LEFT JOIN ({_COVERAGE_COUNTS}) c ON c.feature = k.feature"""))
def q_feature_coverage(spark, sf):
    """AG11: key features present in the table, with non-NULL counts."""
    return matrix.feature_coverage(spark, featured(spark, sf))


_HEALTHY_UNPIVOT = ("SELECT feature, value FROM (UNPIVOT (SELECT "
                    + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in AVAILABLE_KEYS)
                    + " FROM featured WHERE target_binary = 0) ON " + ", ".join(AVAILABLE_KEYS)
                    + " INTO NAME feature VALUE value)")
BASELINE_SQL = f""",
baseline AS (SELECT feature, median(value) AS median FROM ({_HEALTHY_UNPIVOT}) u GROUP BY feature)"""


@register("healthy_baseline", _q(FEATURED_SQL + BASELINE_SQL, f"SELECT feature, {sql_round6('median')} AS median FROM baseline"))
def q_healthy_baseline(spark, sf):
    """AG6: exact medians of the 0-filled key features over healthy rows."""
    return rounded(matrix.healthy_baseline(featured(spark, sf), digits=None))


@register("class_ratio", _q(FEATURED_SQL, """SELECT n_neg, n_pos, n_neg / greatest(n_pos, 1) AS scale_pos_weight,
  CASE WHEN n_pos > 0 THEN n_neg / n_pos ELSE 1.0 END AS scale_pos_weight_light
FROM (SELECT CAST(sum(CASE WHEN target_binary = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
  CAST(sum(CASE WHEN target_binary = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM featured) c"""))
def q_class_ratio(spark, sf):
    """AG7: class imbalance ratios."""
    return matrix.class_ratio(featured(spark, sf))


@register("class_weights", _q(FEATURED_SQL, """SELECT class, n_class,
  (sum(n_class) OVER ()) / (count(*) OVER () * n_class) AS weight
FROM (SELECT target_multiclass AS class, count(*) AS n_class FROM featured GROUP BY 1) c"""))
def q_class_weights(spark, sf):
    """AG8: balanced class weights."""
    return matrix.class_weights(featured(spark, sf))


# ------------------------------------------------------------ lookups ---
_LEVEL_SQL = ("CASE {c} WHEN 0 THEN 'no_risk' WHEN 1 THEN 'degradation_risk' WHEN 2 THEN 'shutdown_risk' "
              "ELSE 'unknown' END")
_REC_SQL = ("CASE {l} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RISK_RECOMMENDATIONS.items())
            + " ELSE 'Monitor closely.' END")


@register("risk_lookup", _q(FEATURED_SQL, "SELECT inverter_id, datetime, target_multiclass, "
                            + _LEVEL_SQL.format(c="target_multiclass") + " AS risk_level, "
                            + _REC_SQL.format(l=_LEVEL_SQL.format(c="target_multiclass"))
                            + " AS recommendation FROM featured"))
def q_risk_lookup(spark, sf):
    """JN2: class -> level -> recommendation (literal map lookups)."""
    f = featured(spark, sf)
    lvl = risk.risk_level(F.col("target_multiclass"))
    return f.select(*KEYS, "target_multiclass", lvl.alias("risk_level"), risk.recommendation(lvl).alias("recommendation"))


@register("risk_band", _q(SCORED_SQL, """SELECT inverter_id, datetime, proxy_prob,
  CASE WHEN proxy_prob > 0.7 THEN 'high' WHEN proxy_prob > 0.4 THEN 'medium' ELSE 'low' END AS band,
  printf('%.2f%%', proxy_prob * 100) AS prob_text FROM scored"""))
def q_risk_band(spark, sf):
    """FN15 + FN16: probability bands and percent text."""
    s = scored(spark, sf)
    return s.select(*KEYS, "proxy_prob", risk.risk_band(F.col("proxy_prob")).alias("band"),
                    risk.percent(F.col("proxy_prob")).alias("prob_text"))


# ------------------------------------------------------------ ranking ---
@register("latest_per_inverter", _q(SCORED_SQL + _LATEST_SQL,
                                    f"SELECT inverter_id, datetime, {sql_round6('inv_power')} AS inv_power, "
                                    "target_multiclass FROM latest"))
def q_latest(spark, sf):
    """WN6: latest reading per inverter."""
    latest = ranking.latest_per_entity(featured(spark, sf).select(*KEYS, "inv_power", "target_multiclass"))
    return rounded(latest)


@register("last_n_readings", _q(FEATURED_SQL, """SELECT inverter_id, datetime, CAST(n - 1 - rd AS INTEGER) AS reading_no
FROM (SELECT inverter_id, datetime, row_number() OVER (PARTITION BY inverter_id ORDER BY datetime DESC) - 1 AS rd,
  least(count(*) OVER (PARTITION BY inverter_id), 10) AS n FROM featured) x WHERE rd < 10"""))
def q_last_n(spark, sf):
    """WN7: last 10 readings per inverter, numbered 0.. ascending."""
    return ranking.last_n_per_entity(featured(spark, sf).select(*KEYS), 10)


POS_SQL = """,
positioned AS (SELECT *, row_number() OVER (ORDER BY inverter_id, datetime) - 1 AS row_pos,
  count(*) OVER () AS n_total FROM featured)"""


@register("row_position", _q(FEATURED_SQL + POS_SQL, "SELECT inverter_id, datetime, row_pos FROM positioned"))
def q_row_position(spark, sf):
    """WN8: global row position in (inverter, datetime) order."""
    return ranking.global_positions(featured(spark, sf).select(*KEYS))


FOLD_SQL = POS_SQL + """,
folded AS (SELECT *, CASE WHEN n_total // 6 > 0 AND row_pos >= n_total - 5 * (n_total // 6)
    THEN CAST((row_pos - (n_total - 5 * (n_total // 6))) // (n_total // 6) AS INTEGER) END AS test_fold,
  row_pos < floor(CAST(0.8 AS DOUBLE) * n_total) AS is_train
  FROM positioned)"""


@register("walk_forward_folds", _q(FEATURED_SQL + FOLD_SQL, "SELECT inverter_id, datetime, row_pos, test_fold FROM folded"))
def q_walk_forward(spark, sf):
    """ML6: walk-forward test fold of every position (train = all earlier positions)."""
    return folds.walk_forward_folds(featured(spark, sf).select(*KEYS)).select(*KEYS, "row_pos", "test_fold")


@register("baseline_sketch", _q(FEATURED_SQL, f"""SELECT k.feature, (SELECT count(*) FROM featured WHERE target_binary = 0) AS n, true AS within_bound
  FROM (VALUES {", ".join(f"('{c}')" for c in AVAILABLE_KEYS)}) k(feature)"""))
def q_baseline_sketch(spark, sf):
    """AG6 (scale option): healthy medians from stored sketches per day; each one's true rank is within the sketch's bound."""
    healthy = featured(spark, sf).where("target_binary = 0").select("datetime", *AVAILABLE_KEYS)
    path = featured_store_path(spark, sf) + f"-sketches-{sketches.K}"
    sketches.write_days(sketches.day_sketches(healthy, AVAILABLE_KEYS), path)
    return sketches.rank_check(healthy, sketches.stored_baseline(spark, path), AVAILABLE_KEYS)


TIME_FOLD_SQL = """,
timed AS (SELECT inverter_id, datetime, row_number() OVER (ORDER BY datetime, inverter_id) - 1 AS row_pos, count(*) OVER () AS n FROM featured),
blocked AS (SELECT *, CASE WHEN n // 6 > 0 AND row_pos >= n - (n // 6) * 5 THEN (row_pos - (n - (n // 6) * 5)) // (n // 6) END AS test_fold FROM timed),
blocks AS (SELECT test_fold AS k, min(row_pos) AS p, min(datetime) AS t FROM blocked WHERE test_fold IS NOT NULL GROUP BY 1),
purged AS (SELECT b.inverter_id, b.datetime, b.row_pos, b.test_fold, (SELECT min(k) FROM blocks WHERE b.row_pos < p AND b.datetime + INTERVAL 168 HOUR <= t) AS trains_from,
  (SELECT min(k) FROM blocks WHERE b.row_pos < p) AS earlier FROM blocked b)"""


@register("walk_forward_time", _q(FEATURED_SQL + TIME_FOLD_SQL, """SELECT inverter_id, datetime, row_pos, CAST(test_fold AS INTEGER) AS test_fold, CAST(trains_from AS INTEGER) AS trains_from,
  CAST(CASE WHEN trains_from IS NULL OR earlier < trains_from THEN earlier END AS INTEGER) AS purged_from FROM purged"""))
def q_walk_forward_time(spark, sf):
    """ML6 in time order: test folds over all inverters, and the folds that a row trains or is purged from (7 days before the test block)."""
    folded = materialize(folds.walk_forward_folds(featured(spark, sf).select(*KEYS), order="time"))
    return folds.with_purge(folded).select(*KEYS, "row_pos", "test_fold", "trains_from", "purged_from")


@register("holdout_split", _q(FEATURED_SQL + FOLD_SQL, "SELECT inverter_id, datetime, is_train FROM folded"))
def q_holdout(spark, sf):
    """ML7: positional 80/20 hold-out."""
    return folds.holdout_split(featured(spark, sf).select(*KEYS)).select(*KEYS, "is_train")


_SHUFFLED = "md5(inverter_id || '|' || CAST(datetime AS VARCHAR) || '|42')"
_FOLDS_SQL = f"""SELECT inverter_id, datetime, target_binary,
  CAST((row_number() OVER (PARTITION BY target_binary ORDER BY {_SHUFFLED}) - 1) % 5 AS INTEGER) AS fold FROM featured"""


@register("stratified_folds", f"{FEATURED_SQL} {_FOLDS_SQL}")
def q_stratified(spark, sf):
    """ML8: stratified shuffled 5-fold assignment (seeded md5 order)."""
    f = featured(spark, sf).select(*KEYS, "target_binary")
    return folds.stratified_folds(f, "target_binary", KEYS)


@register("stratified_fold_sizes", f"{FEATURED_SQL} SELECT target_binary, fold, count(*) AS count FROM ({_FOLDS_SQL}) f GROUP BY 1, 2")
def q_stratified_sizes(spark, sf):
    """ML8 balance: rows per (class, fold); per class the sizes differ by at most one."""
    f = featured(spark, sf).select(*KEYS, "target_binary")
    return folds.stratified_folds(f, "target_binary", KEYS).groupBy("target_binary", "fold").count()


@register("sample_rows", f"{FEATURED_SQL} SELECT inverter_id, datetime, target_binary FROM featured ORDER BY {_SHUFFLED} LIMIT 1000")
def q_sample(spark, sf):
    """SK6: stable seeded sample of 1000 rows (the sample size is the feature)."""
    return ranking.stable_sample(featured(spark, sf).select(*KEYS, "target_binary"), 1000, KEYS)


_PROBS_SQL = """, weights AS (SELECT inverter_id, datetime, [CAST((inverter_idx * 37 + hour * 11) % 100 AS DOUBLE), CAST((inverter_idx * 13 + hour * 29) % 100 AS DOUBLE),
    CAST((day_of_week * 17 + hour * 7) % 100 AS DOUBLE)] AS w FROM featured),
probs AS (SELECT inverter_id, datetime, list_transform(w, lambda x: (x + 1.01) / (w[1] + w[2] + w[3] + 3.03)) AS p FROM weights)"""


@register("class_decision", f"""{FEATURED_SQL}{_PROBS_SQL} SELECT inverter_id, datetime,
  CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS risk_class, round(1.0 - p[1], 4) AS failure_probability FROM probs""")
def q_class_decision(spark, sf):
    """FN13: argmax and 1 - P(class 0) over a probability table derived from the featured rows."""
    w = [(F.col("inverter_idx").cast("long") * 37 + F.col("hour") * 11) % 100, (F.col("inverter_idx").cast("long") * 13 + F.col("hour") * 29) % 100,
         (F.col("day_of_week") * 17 + F.col("hour") * 7) % 100]
    w = [x.cast("double") for x in w]
    probs = F.array(*[(x + 1.01) / (w[0] + w[1] + w[2] + 3.03) for x in w])
    d = featured(spark, sf).select(*KEYS, probs.alias("p"))
    return d.select(*KEYS, risk.argmax_class(F.col("p")).cast("int").alias("risk_class"),
                    risk.failure_probability(F.col("p")).alias("failure_probability"))


@register("entity_readings", f"""{FEATURED_SQL} SELECT inverter_id, datetime, target_binary, target_multiclass FROM featured
WHERE inverter_id = (SELECT min(inverter_id) FROM featured)""")
def q_entity_readings(spark, sf):
    """PRJ13: one inverter's readings (the first id's); the filter reaches the scan."""
    f = featured(spark, sf).select(*KEYS, "target_binary", "target_multiclass")
    return ranking.readings_of(f, f.agg(F.min("inverter_id")).first()[0])
