"""Isolation forest as a Spark job (ML4, ML5).

Training draws ~psi rows per tree in one pass: a row's 63-bit hash falls into the slot of a tree
or into none, so every table size gets whole samples (a tree without rows is an error). Trees are then
grown in parallel with ``groupBy(tree).applyInPandas`` on those small samples
and come back as a nodes table. The forest is bounded (trees x 2*psi nodes),
so it is broadcast for scoring, which runs in ``mapInPandas`` over Arrow batches.
Score = -2^(-E[h(x)] / c(sample size)); the decision offset is the ``contamination``
quantile of the training rows' scores, fixed when the forest is fitted and kept
with it, so a row gets the same flag alone and in any batch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

NODE_SCHEMA = StructType([
    StructField("tree", IntegerType()), StructField("node", IntegerType()),
    StructField("feature", IntegerType()), StructField("threshold", DoubleType()),
    StructField("left", IntegerType()), StructField("right", IntegerType()),
    StructField("size", LongType()),
])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(features: Sequence[str], psi: int, seed: int):
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_o", kind="stable")  # seeded order; keep the first psi
        rng = np.random.default_rng(seed * 100003 + t)
        x = pdf[list(features)].to_numpy(dtype="float64")[:psi]
        rows = []
        stack = [(0, np.arange(len(x)), 0)]
        next_id = 1
        while stack:
            node, idx, depth = stack.pop()
            sub = x[idx]
            if depth >= limit or len(idx) <= 1:
                rows.append((t, node, -1, 0.0, -1, -1, len(idx)))
                continue
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.where(hi > lo)[0]
            if len(cand) == 0:
                rows.append((t, node, -1, 0.0, -1, -1, len(idx)))
                continue
            f = int(rng.choice(cand))
            thr = float(rng.uniform(lo[f], hi[f]))
            left, right = next_id, next_id + 1
            next_id += 2
            rows.append((t, node, f, thr, left, right, len(idx)))
            stack.append((left, idx[sub[:, f] < thr], depth + 1))
            stack.append((right, idx[sub[:, f] >= thr], depth + 1))
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])
    return build


@dataclass(frozen=True)
class Forest:
    """A fitted forest: nodes table, feature names in order, rows per tree, decision offset."""

    nodes: DataFrame
    features: tuple[str, ...]
    sample_size: int
    offset: float


def tree_draws(key: Column, n: int, n_trees: int, psi: int, seed: int) -> Column:
    """The trees whose sample a row joins: each with probability min(1, 1.5 psi / n).

    The trees are dealt over as few draws as keep a draw's slots within the hash range; a draw is one
    63-bit hash, cut into one slot per tree and a rest that joins none.
    """
    rate = min(1.0, 1.5 * psi / max(n, 1))
    draws = max(1, math.ceil(rate * n_trees))
    width = max(1, int(rate * (1 << 63)) - 1)

    def slot(j: Column) -> Column:
        hashed = F.shiftrightunsigned(F.xxhash64(key, j, F.lit(seed)), 1)
        return j + F.lit(draws) * ((hashed - F.pmod(hashed, F.lit(width))) / F.lit(width) + F.lit(0.5)).cast("long")

    return F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")), slot), lambda t: t < n_trees)


def fit(df: DataFrame, features: Sequence[str], keys: Sequence[str], n_trees: int = 200, psi: int = 256,
        contamination: float = 0.05, seed: int = 42, n_rows: int | None = None) -> Forest:
    """ML4: isolation forest over ``features`` (NULL -> 0); ``n_rows`` when the caller knows the count."""
    from ..session import materialize, ship_package
    ship_package(df.sparkSession)
    n = df.count() if n_rows is None else n_rows
    key = F.xxhash64(*[F.col(k) for k in keys])
    clean = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    sample = (df.select(*clean, key.alias("_k"), F.explode(tree_draws(key, n, n_trees, psi, seed)).alias("tree"))
              .withColumn("tree", F.col("tree").cast("int"))
              .withColumn("_o", F.xxhash64("_k", "tree", F.lit(seed + 1))))
    nodes = materialize(sample.groupBy("tree").applyInPandas(_grow(features, psi, seed), NODE_SCHEMA))
    grown = nodes.where("node = 0").agg(F.countDistinct("tree").alias("trees"), F.max("size").alias("size")).first()
    if grown.trees != n_trees:
        raise ValueError(f"{n_trees - grown.trees} of {n_trees} trees drew no rows from a table of {n}")
    forest = Forest(nodes, tuple(features), int(grown["size"]), 0.0)
    offset = score(df, forest).agg(F.percentile_approx("iso_score", contamination, 100_000)).first()[0]
    return replace(forest, offset=float(offset))


def fit_many(df: DataFrame, features: Sequence[str], keys: Sequence[str], trains: Sequence[Column], n_trees: int = 200, psi: int = 256,
             contamination: float = 0.05, seed: int = 42) -> list[Forest]:
    """One forest for each condition of ``trains``, fitted on the rows that meet it; all trees are grown in one job.

    Forest k is the one that ``fit`` with seed ``seed + k`` would draw; a condition that no row meets raises.
    """
    from ..session import materialize, ship_package
    ship_package(df.sparkSession)
    sizes = df.agg(*(F.count_if(c).alias(f"n{k}") for k, c in enumerate(trains))).first()
    key = F.xxhash64(*[F.col(k) for k in keys])
    clean = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    moved = lambda first: lambda t: t + F.lit(first)
    draws = F.concat(*(F.when(c, F.transform(tree_draws(key, n, n_trees, psi, seed + k), moved(k * n_trees)))
                       .otherwise(F.array().cast("array<bigint>")) for k, (c, n) in enumerate(zip(trains, sizes))))
    sample = (df.select(*clean, key.alias("_k"), F.explode(draws).alias("tree")).withColumn("tree", F.col("tree").cast("int"))
              .withColumn("_o", F.xxhash64("_k", "tree", F.lit(seed + 1))))
    nodes = materialize(sample.groupBy("tree").applyInPandas(_grow(features, psi, seed), NODE_SCHEMA))
    grown = {r.f: r for r in nodes.where("node = 0").groupBy(F.floor(F.col("tree") / n_trees).alias("f"))
             .agg(F.countDistinct("tree").alias("trees"), F.max("size").alias("size")).collect()}
    out = []
    for k, c in enumerate(trains):
        if k not in grown or grown[k].trees != n_trees:
            raise ValueError(f"trees of forest {k} drew no rows from {sizes[k]}")
        own = nodes.where((F.col("tree") >= k * n_trees) & (F.col("tree") < (k + 1) * n_trees)).withColumn("tree", (F.col("tree") - k * n_trees).cast("int"))
        forest = Forest(own, tuple(features), int(grown[k].size), 0.0)
        offset = score(df.where(c), forest).agg(F.percentile_approx("iso_score", contamination, 100_000)).first()[0]
        out.append(replace(forest, offset=float(offset)))
    return out


def _path_scorer(nodes: pd.DataFrame, features: Sequence[str], psi: int, out_col: str):
    trees = []
    for _, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        size = int(g["node"].max()) + 1
        arr = {k: np.zeros(size, dtype=dt) for k, dt in
               [("feature", np.int64), ("threshold", np.float64), ("left", np.int64), ("right", np.int64), ("size", np.int64)]}
        for col in arr:
            arr[col][g["node"].to_numpy()] = g[col].to_numpy()
        trees.append(arr)
    cpsi = c_factor(psi)

    def score(batches):
        for pdf in batches:
            x = pdf[list(features)].fillna(0.0).to_numpy(dtype="float64")
            depth_sum = np.zeros(len(x))
            for tr in trees:
                node = np.zeros(len(x), dtype=np.int64)
                depth = np.zeros(len(x))
                active = tr["feature"][node] >= 0
                while active.any():
                    f = tr["feature"][node[active]]
                    go_left = x[np.where(active)[0], f] < tr["threshold"][node[active]]
                    node[active] = np.where(go_left, tr["left"][node[active]], tr["right"][node[active]])
                    depth[active] += 1
                    active = tr["feature"][node] >= 0
                depth_sum += depth + np.array([c_factor(s) for s in tr["size"][node]])
            mean_depth = depth_sum / max(len(trees), 1)
            pdf[out_col] = -np.power(2.0, -mean_depth / cpsi) if cpsi > 0 else -0.5
            yield pdf
    return score


def score(df: DataFrame, forest: Forest, out_col: str = "iso_score") -> DataFrame:
    """Raw isolation score per row (higher = more normal), in Arrow batches."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    nodes = forest.nodes.toPandas()  # bounded: trees x (2 * psi) nodes
    schema = StructType(df.schema.fields + [StructField(out_col, DoubleType())])
    return df.mapInPandas(_path_scorer(nodes, forest.features, forest.sample_size, out_col), schema)


def add_anomaly_scores(df: DataFrame, forest: Forest) -> DataFrame:
    """ML5: ``anomaly_score`` = score - the fitted offset, ``is_anomaly`` = it is below 0."""
    return (score(df, forest).withColumn("anomaly_score", F.col("iso_score") - F.lit(forest.offset))
            .withColumn("is_anomaly", (F.col("anomaly_score") < 0).cast("int")).drop("iso_score"))


def save_forest(forest: Forest, path: str) -> None:
    """SRC10: nodes and what scoring needs beside them."""
    forest.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    meta = [(list(forest.features), forest.sample_size, forest.offset)]
    (forest.nodes.sparkSession.createDataFrame(meta, "features array<string>, sample_size int, offset double")
     .write.mode("overwrite").parquet(f"{path}/meta"))


def load_forest(spark: SparkSession, path: str) -> Forest:
    meta = spark.read.parquet(f"{path}/meta").first()
    return Forest(spark.read.parquet(f"{path}/nodes"), tuple(meta["features"]), meta["sample_size"], meta["offset"])
