"""Classification metrics as aggregations (ML9-ML13, AG10).

Every metric reduces the scored rows to a tiny confusion table first
(partial + final aggregate), so the expensive part scales like a groupBy.
``by`` groups metrics per fold / task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import bucketed_prefix


def _ratio(num: Column, den: Column) -> Column:
    """zero_division = 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """ML9: tp/fp/fn/tn, precision, recall, F1 (positive class 1)."""
    t, p = F.col(y) == 1, F.col(yhat) == 1
    cnt = df.groupBy(*by).agg(
        F.sum((t & p).cast("long")).alias("tp"), F.sum((~t & p).cast("long")).alias("fp"),
        F.sum((t & ~p).cast("long")).alias("fn"), F.sum((~t & ~p).cast("long")).alias("tn"))
    prec = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return cnt.select(*by, "tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"),
                      _f1(prec, rec).alias("f1"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (),
            buckets: int = 65536) -> DataFrame:
    """ML10: ROC AUC with tie-averaged ranks (Mann-Whitney U); 0 when one class is absent.

    Rows collapse to a per-score histogram (pos, neg); negatives strictly below
    each score come from bucketed prefix sums over the histogram. Scores are
    probabilities in [0, 1] (bucket = floor(score * buckets)).
    """
    hist = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    bucket = F.least(F.greatest(F.floor(F.col("_s") * buckets), F.lit(0)), F.lit(buckets - 1))
    pre = bucketed_prefix(hist, "_s", ["neg"], bucket, partition=by)
    u = pre.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return u.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
                    .otherwise(F.lit(0.0)).alias("auc"))


def per_class_counts(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Per class present in truth or prediction: tp, fp, fn, support."""
    pairs = df.groupBy(*by, F.col(y).alias("_y"), F.col(yhat).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    as_truth = pairs.select(*by, F.col("_y").alias("class"), F.when(F.col("_y") == F.col("_p"), F.col("_c")).otherwise(0).alias("tp"),
                            F.lit(0).cast("long").alias("fp"),
                            F.when(F.col("_y") != F.col("_p"), F.col("_c")).otherwise(0).alias("fn"),
                            F.col("_c").alias("support"))
    as_pred = pairs.select(*by, F.col("_p").alias("class"), F.lit(0).cast("long").alias("tp"),
                           F.when(F.col("_y") != F.col("_p"), F.col("_c")).otherwise(0).alias("fp"),
                           F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support"))
    return (as_truth.unionByName(as_pred).groupBy(*by, "class")
            .agg(*[F.sum(c).cast("long").alias(c) for c in ["tp", "fp", "fn", "support"]]))


def per_class_scores(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    c = per_class_counts(df, y, yhat, by)
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*by, "class", "support", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def macro_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """ML11: unweighted means of per-class precision / recall / F1."""
    s = per_class_scores(df, y, yhat, by)
    return s.groupBy(*by).agg(F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
                              F.avg("f1").alias("f1_macro"))


def weighted_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """ML12: support-weighted means of per-class precision / recall / F1."""
    s = per_class_scores(df, y, yhat, by)
    tot = F.sum("support")
    return s.groupBy(*by).agg(*[_ratio(F.sum(F.col(m) * F.col("support")), tot).alias(f"{m}_weighted")
                                for m in ("precision", "recall", "f1")])


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """ML13: per-class rows plus accuracy, macro avg and weighted avg rows.

    Columns: label, precision, recall, f1, support (accuracy row: f1 = accuracy).
    """
    s = per_class_scores(df, y, yhat).where(F.col("support") > 0).select(
        F.col("class").cast("string").alias("label"), "precision", "recall", "f1", "support")
    s_all = per_class_scores(df, y, yhat)
    n = F.sum("support")
    macro = s_all.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                      F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support"))
    weighted = s_all.agg(F.lit("weighted avg").alias("label"),
                         *[_ratio(F.sum(F.col(m) * F.col("support")), n).alias(m) for m in ("precision", "recall", "f1")],
                         n.alias("support"))
    acc = df.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("f1"),
                 F.count(F.lit(1)).alias("support"))
    return s.unionByName(acc).unionByName(macro).unionByName(weighted).withColumn("support", F.col("support").cast("long"))


def fold_aggregate(long_metrics: DataFrame, by: Sequence[str] = ("task", "metric")) -> DataFrame:
    """AG10: mean and population std of each metric over folds (long input: ..., value)."""
    return long_metrics.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def binary_with_auc(df: DataFrame, y: str, yhat: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ML9 + ML10 side by side (joined on the grouping keys; one row per group)."""
    b = binary_metrics(df, y, yhat, by)
    a = roc_auc(df, y, score, by)
    if by:
        return b.join(a, list(by))
    # no grouping: the AUC is one scalar, attached as a literal (no cross join)
    return b.withColumn("auc", F.lit(float(a.first()["auc"])))


def to_long(df: DataFrame, id_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """RP2: wide fold metrics -> (ids..., metric, value)."""
    return df.select(*id_cols, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                  for m in metrics])).alias("_m")).select(*id_cols, "_m.metric", "_m.value")


def pr_auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), buckets: int = 65536) -> DataFrame:
    """Area under the precision-recall curve as average precision, equal scores taken together; 0 without a positive row.

    Like ``roc_auc``: rows collapse to a histogram per score, and what scores above each score comes from bucketed prefix sums
    (scores in [0, 1], the largest first).
    """
    hist = df.groupBy(*by, (-F.col(score)).alias("_s")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    bucket = F.least(F.greatest(F.floor((1 + F.col("_s")) * buckets), F.lit(0)), F.lit(buckets - 1))
    pre = bucketed_prefix(hist, "_s", ["pos", "n"], bucket, partition=by)
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    u = pre.groupBy(*by).agg(F.sum(F.col("pos") * precision).alias("_u"), F.sum("pos").alias("_p"))
    return u.select(*by, F.when(F.col("_p") > 0, F.col("_u") / F.col("_p")).otherwise(F.lit(0.0)).alias("pr_auc"))
