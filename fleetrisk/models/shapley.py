"""Shapley values of a boosted model's margin by permutation sampling (ML14, ML15).

A permutation's features are switched from a background row to the explained row one after the other; the change of the margin is credited to
the feature switched. Permutations come in antithetic pairs (each with its reverse), every pair with a background row of its own, so
the credits of a pair add up exactly to the margin less the background row's (Mitchell et al., "Sampling permutations for Shapley value
estimation", JMLR 2022). The spread over pairs gives each value's standard error. Rows are explained in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..operators.ranking import stable_sample
from ..session import ship_package
from . import boost

#: Rows that are evaluated at a time.
STEP = 256

SHAPLEY = StructType([StructField("feature", StringType()), StructField("value", DoubleType()), StructField("impact", DoubleType()),
                      StructField("error", DoubleType()), StructField("direction", StringType())])


def shapley_values(x: np.ndarray, margin: Callable[[np.ndarray], np.ndarray], background: np.ndarray, pairs: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, standard errors) of each row and feature, and the base value: values of a row add up to its margin less the base.

    Background rows are used in turn. The same permutations serve all rows, so a row's values don't depend on its batch.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    total, square, base = np.zeros((n, d)), np.zeros((n, d)), 0.0
    for p in range(pairs):
        z = background[p % len(background)]
        start = float(margin(z[None])[0])
        base += start / pairs
        perm = rng.permutation(d)
        both = np.zeros((n, d))
        for order in (perm, perm[::-1]):
            on = np.zeros((d, d), bool)  # step k: the first k + 1 features of the order are the row's
            for k in range(d):
                on[k:, order[k]] = True
            steps = margin(np.where(on[None], x[:, None], z).reshape(n * d, d)).reshape(n, d)
            both[:, order] += np.diff(steps, axis=1, prepend=start) / 2
        total += both
        square += both * both
    mean = total / pairs
    spread = np.maximum(square / pairs - mean * mean, 0) * (pairs / max(pairs - 1, 1))
    return mean, np.sqrt(spread / pairs), base


def background_rows(df: DataFrame, features: Sequence[str], keys: Sequence[str], n: int = 64) -> np.ndarray:
    """``n`` rows of ``df`` in the seeded order of their keys, as the model reads them: what explanations compare with."""
    rows = stable_sample(df, n, keys).select(*(boost._known(c).alias(f"_f{i}") for i, c in enumerate(features))).collect()
    if not rows:
        raise ValueError("no background rows")
    return np.array([tuple(r) for r in rows], float)


def add_shapley(df: DataFrame, model: boost.Boosted, background: np.ndarray, pairs: int = 32, k: int | None = 5, output: int = 0,
                out: str = "top_risk_factors") -> DataFrame:
    """``df`` with its ``k`` (None: all) features of largest |Shapley value|, ties by name, and ``base_value``.

    An entry holds feature, value (0 for null), impact on the margin of ``output``, its standard error and direction.
    ``background``: at most some hundred rows (``background_rows``); work per row is 2 x ``pairs`` x features margins.
    """
    ship_package(df.sparkSession)
    feats, trees = list(model.features), boost._arrays(model)
    by_name = sorted(range(len(feats)), key=feats.__getitem__)
    inputs = [f"_f{i}" for i in range(len(feats))]
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(SHAPLEY)), StructField("base_value", DoubleType())])

    def margin(rows: np.ndarray) -> np.ndarray:
        return boost.raw_margins(rows, model, trees)[:, output]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                pdf = batch.iloc[lo:lo + STEP]
                x = pdf[inputs].to_numpy(dtype="float64")
                pdf = pdf.drop(columns=inputs)
                phi, err, base = shapley_values(x, margin, background, pairs)
                best = np.argsort(-np.abs(phi[:, by_name]), axis=1, kind="stable")[:, :k]
                shown = np.where(x == boost.MISSING, 0.0, x)
                pdf[out] = pd.Series([[{"feature": feats[j], "value": float(shown[r, j]), "impact": float(phi[r, j]), "error": float(err[r, j]),
                                        "direction": "increases risk" if phi[r, j] > 0 else "decreases risk"} for j in (by_name[b] for b in row)]
                                      for r, row in enumerate(best)], index=pdf.index, dtype=object)
                pdf["base_value"] = base
                yield pdf
    return df.select("*", *(boost._known(c).alias(i) for c, i in zip(feats, inputs))).mapInPandas(run, schema)


def mean_shapley(explained: DataFrame, column: str = "top_risk_factors") -> DataFrame:
    """(feature, mean_abs_impact) over rows explained with all features (``k=None``)."""
    return (explained.select(F.explode(column).alias("d")).groupBy(F.col("d.feature").alias("feature"))
            .agg(F.avg(F.abs("d.impact")).alias("mean_abs_impact")))
