"""Boosted-tree risk models on MLlib (ML1-ML3, FN13).

* binary: ``GBTClassifier`` with positive-class weight = neg / max(pos, 1) (AG7)
* 3-class: MLlib boosting is binary only, so one GBT per class
  (one-vs-rest); the three positive-class probabilities are normalised to sum
  to 1, then argmax gives the class and 1 - P(class 0) the failure probability.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import class_weights


@dataclass
class BoostParams:
    """Reference settings: 500 rounds, depth 6, lr 0.05, row/column subsample 0.8."""
    max_iter: int = 500
    max_depth: int = 6
    step_size: float = 0.05
    subsample: float = 0.8
    feature_subset: str = "0.8"
    seed: int = 42


LIGHT = BoostParams(max_iter=300, step_size=0.08, subsample=1.0, feature_subset="all")


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], Any]], parallelism: int = 4) -> list:
    """Fits that don't need each other, submitted together (as MLlib's cross validation does); results in order."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(j) for j in jobs], chunksize=1)


def _gbt(p: BoostParams, label: str, weight: str | None, validation: str | None) -> GBTClassifier:
    kw = dict(featuresCol="features", labelCol=label, maxIter=p.max_iter, maxDepth=p.max_depth,
              stepSize=p.step_size, subsamplingRate=p.subsample, featureSubsetStrategy=p.feature_subset,
              seed=p.seed)
    if weight:
        kw["weightCol"] = weight
    if validation:  # rounds stop when the loss on these rows falls by less than MLlib's tolerance of 1 %
        kw["validationIndicatorCol"] = validation
    return GBTClassifier(**kw)


def train_binary(df: DataFrame, features: Sequence[str], label: str = "target_binary",
                 params: BoostParams = BoostParams(), validation: str | None = None) -> PipelineModel:
    """ML1/ML3: weighted binary GBT; weight = scale_pos_weight on positives.

    ``validation`` names a boolean column: its rows don't train, they stop the boosting early.
    """
    own = df.where(~F.col(validation)) if validation else df
    c = own.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"),
               F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")).first()
    scale = (c["neg"] or 0) / max(c["pos"] or 0, 1)  # AG7, a scalar
    w = df.withColumn("_w", F.when(F.col(label) == 1, F.lit(float(scale))).otherwise(F.lit(1.0)))
    w = w.withColumn("_label", F.col(label).cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
                            _gbt(params, "_label", "_w", validation)])
    return pipe.fit(w)


def score_binary(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return (out.withColumn("p_failure", vector_to_array(F.col("probability"))[1])
            .withColumnRenamed("prediction", "pred_binary").drop("features", "rawPrediction", "probability"))


def train_multiclass(df: DataFrame, features: Sequence[str], label: str = "target_multiclass",
                     params: BoostParams = BoostParams(), classes: Sequence[int] = (0, 1, 2),
                     balanced: bool = False, validation: str | None = None) -> list[PipelineModel]:
    """ML2: one-vs-rest GBTs; ``balanced`` weighs rows by class (AG8), as the light final fit does (ML3).

    ``validation``: see ``train_binary``.
    """
    weighted, weight = df, None
    if balanced:
        own = df.where(~F.col(validation)) if validation else df
        cw = class_weights(own, label).select(F.col("class").alias(label), F.col("weight").alias("_cw"))
        weighted, weight = df.join(F.broadcast(cw), label, "left"), "_cw"  # one row per class
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    def one(k: int) -> PipelineModel:
        d = weighted.withColumn("_y", (F.col(label) == k).cast("double"))
        return Pipeline(stages=[asm, _gbt(params, "_y", weight, validation)]).fit(d)
    return side_by_side(df.sparkSession, [lambda k=k: one(k) for k in classes])


def score_multiclass(models: list[PipelineModel], df: DataFrame) -> DataFrame:
    """Class probabilities ``probs`` (normalised), ``risk_class`` (argmax) and ``failure_probability``."""
    out = df
    for k, m in enumerate(models):
        out = m.transform(out).withColumn(f"_p{k}", vector_to_array(F.col("probability"))[1]) \
            .drop("features", "rawPrediction", "probability", "prediction")
    total = sum((F.col(f"_p{k}") for k in range(len(models))), F.lit(0.0))
    probs = F.array(*[F.when(total > 0, F.col(f"_p{k}") / total).otherwise(F.lit(1.0 / len(models)))
                      for k in range(len(models))])
    from ..operators.risk import argmax_class, failure_probability
    out = out.withColumn("probs", probs).drop(*[f"_p{k}" for k in range(len(models))])
    return out.withColumn("risk_class", argmax_class(F.col("probs"))) \
              .withColumn("failure_probability", failure_probability(F.col("probs")))
