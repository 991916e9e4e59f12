"""Per-row feature attribution of a fitted MLlib GBT (ML14, ML15).

Path attribution: walking a row down each tree, every split moves the node
value from parent to child; that change (times the tree weight) is credited
to the split's feature. Per row, contributions plus the bias (weighted root
values) add up exactly to the model margin (raw prediction).

The ensemble is read as data: the fitted model is saved to the shared scratch
folder and its node table (MLlib's persisted parquet layout) is loaded with
``spark.read.parquet`` -- trees x 2^depth rows, a structural bound, so it is
collected once and shipped to the ``mapInPandas`` scorer. Scoring runs over
Arrow batches of the (distributed) rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..session import scratch_path, ship_package


def gbt_nodes(spark: SparkSession, model: GBTClassificationModel) -> pd.DataFrame:
    """Node table: tree, node, feature, threshold, left, right, value, weight."""
    path = scratch_path(spark, f"models/gbt-{uuid.uuid4().hex[:12]}")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold"),  # leaves: empty
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.prediction").alias("value"))
    nodes = data.toPandas()  # bounded: trees x (2^(depth+1) - 1) rows
    w = pd.Series(list(model.treeWeights), name="weight")
    nodes["weight"] = nodes["tree"].map(w)
    return nodes


def _arrays(nodes: pd.DataFrame):
    out = []
    for _, g in nodes.groupby("tree"):
        n = int(g["node"].max()) + 1
        a = {k: np.full(n, -1, dtype=np.int64) for k in ("feature", "left", "right")}
        a["threshold"] = np.zeros(n)
        a["value"] = np.zeros(n)
        idx = g["node"].to_numpy()
        for k in ("feature", "left", "right"):
            a[k][idx] = g[k].to_numpy()
        a["threshold"][idx] = g["threshold"].fillna(0.0).to_numpy()
        a["value"][idx] = g["value"].to_numpy()
        a["weight"] = float(g["weight"].iloc[0])
        out.append(a)
    return out


def contributions(x: np.ndarray, trees) -> tuple[np.ndarray, np.ndarray]:
    """(n_rows, n_features) path contributions and (n_rows,) bias for a numpy batch."""
    n, m = x.shape
    contrib = np.zeros((n, m))
    bias = np.zeros(n)
    rows = np.arange(n)
    for t in trees:
        node = np.zeros(n, dtype=np.int64)
        bias += t["weight"] * t["value"][0]
        active = t["left"][node] >= 0
        while active.any():
            r = rows[active]
            nd = node[active]
            f = t["feature"][nd]
            go_left = x[r, f] <= t["threshold"][nd]
            child = np.where(go_left, t["left"][nd], t["right"][nd])
            np.add.at(contrib, (r, f), t["weight"] * (t["value"][child] - t["value"][nd]))
            node[active] = child
            active = t["left"][node] >= 0
    return contrib, bias


DRIVER = StructType([StructField("feature", StringType()), StructField("value", DoubleType()),
                     StructField("impact", DoubleType()), StructField("direction", StringType())])


def _cleaned(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])


def add_drivers(df: DataFrame, nodes: pd.DataFrame, features: Sequence[str], k: int = 5,
                out: str = "top_risk_factors") -> DataFrame:
    """ML15 + SK5 + FN14: the row's ``k`` features of largest |impact|, best first, ties by name, as an array
    of (feature, value, impact, direction), and ``base_value``, the bias. Ranked inside the row: no shuffle.

    ``features`` must not hold NULLs (they count as 0); other columns pass through.
    """
    ship_package(df.sparkSession)
    trees, feats = _arrays(nodes), list(features)
    by_name = sorted(range(len(feats)), key=feats.__getitem__)
    schema = StructType(df.schema.fields + [StructField(out, ArrayType(DRIVER)), StructField("base_value", DoubleType())])

    def run(batches):
        for pdf in batches:
            x = pdf[feats].fillna(0.0).to_numpy(dtype="float64")
            c, bias = contributions(x, trees)
            best = np.argsort(-np.abs(c[:, by_name]), axis=1, kind="stable")[:, :k]
            pdf[out] = pd.Series([[{"feature": feats[j], "value": float(x[r, j]), "impact": float(c[r, j]),
                                    "direction": "increases risk" if c[r, j] > 0 else "decreases risk"}
                                   for j in (by_name[b] for b in row)] for r, row in enumerate(best)],
                                 index=pdf.index, dtype=object)
            pdf["base_value"] = bias
            yield pdf
    return df.mapInPandas(run, schema)


def mean_impacts(df: DataFrame, nodes: pd.DataFrame, features: Sequence[str]) -> DataFrame:
    """ML14: (feature, mean_abs_impact) over all rows; a batch sends one row per feature to the sum."""
    ship_package(df.sparkSession)
    trees, feats = _arrays(nodes), list(features)
    schema = StructType([StructField("feature", StringType()), StructField("total", DoubleType()), StructField("n", LongType())])

    def run(batches):
        for pdf in batches:
            c, _ = contributions(pdf[feats].to_numpy(dtype="float64"), trees)
            yield pd.DataFrame({"feature": feats, "total": np.abs(c).sum(axis=0), "n": len(pdf)})
    parts = _cleaned(df, feats, []).mapInPandas(run, schema)
    return parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_abs_impact"))


def top_features(df: DataFrame, nodes: pd.DataFrame, features: Sequence[str], k: int = 10) -> DataFrame:
    """ML14: the ``k`` features of largest mean |impact|, ranked from 1 (one row per feature is ranked)."""
    w = Window.orderBy(F.desc("mean_abs_impact"), "feature")
    return mean_impacts(df, nodes, features).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


ATTR_SCHEMA_FIELDS = [StructField("feature", StringType()), StructField("value", DoubleType()),
                      StructField("impact", DoubleType()), StructField("base_value", DoubleType())]


def attribute(df: DataFrame, nodes: pd.DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long attribution table: keys..., feature, value, impact, base_value (one row per row x feature)."""
    ship_package(df.sparkSession)
    trees = _arrays(nodes)
    feats = list(features)
    key_fields = [f for f in df.schema.fields if f.name in set(keys)]
    schema = StructType(key_fields + ATTR_SCHEMA_FIELDS)

    def run(batches):
        for pdf in batches:
            x = pdf[feats].fillna(0.0).to_numpy(dtype="float64")
            c, b = contributions(x, trees)
            n, m = c.shape
            out = {k: np.repeat(pdf[k].to_numpy(), m) for k in keys}
            out["feature"] = np.tile(np.array(feats, dtype=object), n)
            out["value"] = x.reshape(-1)
            out["impact"] = c.reshape(-1)
            out["base_value"] = np.repeat(b, m)
            yield pd.DataFrame(out)
    return _cleaned(df, feats, keys).mapInPandas(run, schema)
