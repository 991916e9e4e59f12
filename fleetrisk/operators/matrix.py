"""Feature matrix, key-feature selection, padding, coverage, baseline, class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..schema import EXCLUDE_COLS, KEY_FEATURES
from .stats import exact_median_long


def feature_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDE_COLS) -> list[str]:
    """PRJ8: numeric columns minus the identifier / leak columns."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def clean(c: Column) -> Column:
    """PRJ9: NULL, NaN and +/-inf become 0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)


def feature_matrix(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ8 + PRJ9: cleaned numeric feature columns (plus ``keep`` pass-through columns)."""
    return df.select(*keep, *[clean(F.col(c)).alias(c) for c in feature_columns(df) if c not in keep])


def available_key_features(df: DataFrame, features: Sequence[str] = KEY_FEATURES) -> list[str]:
    cols = set(df.columns)
    return [f for f in features if f in cols]


def key_feature_frame(df: DataFrame, features: Sequence[str] = KEY_FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ10 + PRJ7: available key features, NULL -> 0 (inf kept), non-null targets.

    The 3-class target falls back to the binary one when absent; missing -> 0.
    """
    avail = available_key_features(df, features)
    multi = F.col("target_multiclass") if "target_multiclass" in df.columns else F.col("target_binary")
    return (df.where(F.col("target_binary").isNotNull())
            .select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in avail],
                    F.col("target_binary").cast("int").alias("target_binary"),
                    F.coalesce(multi, F.lit(0)).cast("int").alias("target_multiclass")))


def pad_to_model(df: DataFrame, model_features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ11: exact model column order; present columns cleaned, absent columns 0.0."""
    cols = set(df.columns)
    return df.select(*keep, *[(clean(F.col(c)) if c in cols else F.lit(0.0)).alias(c) for c in model_features])


def feature_coverage(spark: SparkSession, df: DataFrame, features: Sequence[str] = KEY_FEATURES) -> DataFrame:
    """AG11: for each key feature, whether the table has it and its non-NULL count."""
    avail = available_key_features(df, features)
    counts = df.agg(*[F.count(c).alias(c) for c in avail]) if avail else None
    catalogue = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string")
    if counts is None:
        return catalogue.select("position", "feature", F.lit(False).alias("available"),
                                F.lit(0).cast("long").alias("non_null"))
    stacked = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("non_null"))
                                                for c in avail])).alias("s")).select("s.*")
    return (catalogue.join(stacked, "feature", "left")
            .select("position", "feature", F.col("non_null").isNotNull().alias("available"),
                    F.coalesce("non_null", F.lit(0)).cast("long").alias("non_null")))


def unpivot(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*id_cols, F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in value_cols])).alias("_kv")
    ).select(*id_cols, f"_kv.{name}", f"_kv.{value}")


def healthy_baseline(df: DataFrame, features: Sequence[str] | None = None, digits: int | None = 6) -> DataFrame:
    """AG6: exact median of every (0-filled) feature over healthy rows (target_binary = 0).

    ``features=None`` uses the available key features (30-feature variant,
    rounded to 6 places); pass ``feature_columns(df)`` for the full variant.
    Output: feature, median.
    """
    feats = list(features) if features is not None else available_key_features(df)
    healthy = df.where(F.col("target_binary") == 0).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                                            for c in feats])
    med = exact_median_long(unpivot(healthy, [], feats))
    if digits is not None:
        med = med.select("feature", F.round("median", digits).alias("median"))
    return med


def class_ratio(df: DataFrame, target: str = "target_binary") -> DataFrame:
    """AG7: neg/pos counts, scale weight neg/max(pos,1), light variant neg/pos (1.0 if pos = 0)."""
    neg = F.sum(F.when(F.col(target) == 0, 1).otherwise(0)).cast("long")
    pos = F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).cast("long")
    agg = df.agg(neg.alias("n_neg"), pos.alias("n_pos"))
    return agg.select("n_neg", "n_pos",
                      (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("scale_pos_weight"),
                      F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0))
                      .alias("scale_pos_weight_light"))


def class_weights(df: DataFrame, target: str = "target_multiclass") -> DataFrame:
    """AG8: balanced weight n / (k * n_c) per present class."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n_class"))
    # one row per class: the totals are window aggregates over that tiny table
    every = Window.partitionBy()
    return counts.select("class", "n_class", (F.sum("n_class").over(every)
                                              / (F.count(F.lit(1)).over(every) * F.col("n_class"))).alias("weight"))
