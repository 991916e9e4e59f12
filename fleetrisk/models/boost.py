"""Gradient boosting in rounds of MLlib regression trees, stopped and cut by a validation metric (ML1-ML3).

* binary: logistic loss, validated by PR-AUC; 3-class: one joint softmax model (a tree per class and round), validated by log loss
* a round fits trees to the residuals of a hashed sample of the rows and re-estimates each leaf by one aggregate,
  sum(w r) / (sum(w h) + l2), the Newton step of the loss
* a row passes a round's trees once: its leaves are kept beside it until the next round has its own, so no round runs the trees before it again
* rounds run in blocks: after a block the rows are written with their new margins, those of the validation rows after every round of the block,
  so one pass gives the metric of every round; ``patience`` rounds without a better one end the boosting and the best round is kept

A model is a table of nodes, rounds x classes x (2^(depth + 1) - 1) rows at most, so it is broadcast for scoring.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..operators import metrics
from ..operators.matrix import class_weights
from ..session import materialize, ship_package
from .gbt import BoostParams, side_by_side

#: Rounds between two looks at the validation rows.
BLOCK = 10
#: Rows up to which a task of its own doesn't pay where many fits run side by side: a round takes some 25 passes, most of them a task's fixed cost on so few rows.
PART_ROWS = 1 << 13
#: Bins of a probability in the validation histograms.
BINS = 1 << 16
L2 = 1.0
#: What null and NaN features count as: less than any value, so they go left at every split of values.
MISSING = -1e300
NODE_COLUMNS = ["round", "cls", "node", "feature", "threshold", "left", "right", "value"]


@dataclass
class Boosted:
    """A fitted model: nodes of all kept rounds, start margins by class, and the metric after every round that was trained."""
    features: tuple[str, ...]
    classes: tuple[int, ...]
    step_size: float
    base: tuple[float, ...]
    nodes: pd.DataFrame
    rounds: int = 0
    metric: str = ""
    history: list[float] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return len(self.base)

    def upto(self, rounds: int) -> Boosted:
        return replace(self, rounds=rounds, nodes=self.nodes[self.nodes["round"] < rounds].reset_index(drop=True))

    def node_table(self, cls: int = 0) -> pd.DataFrame:
        """Nodes of one output in the layout of ``explain.gbt_nodes``; the start margin is a tree of one node."""
        own = self.nodes[self.nodes["cls"] == cls]
        start = pd.DataFrame([{"tree": -1, "node": 0, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "value": self.base[cls], "weight": 1.0}])
        if not len(own):
            return start
        return pd.concat([start, own.rename(columns={"round": "tree"}).drop(columns="cls").assign(weight=self.step_size)], ignore_index=True)


_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def tree_nodes(described: str) -> list[dict]:
    """Nodes of an MLlib regression tree on continuous features, in preorder, from its description; leaves come left to right."""
    lines = iter([ln.strip() for ln in described.splitlines()[1:] if ln.strip()])
    out: list[dict] = []

    def read() -> int:
        line = next(lines)
        at = len(out)
        out.append({"node": at, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "value": 0.0})
        if m := _SPLIT.match(line):
            left = read()
            if not next(lines).startswith("Else"):
                raise ValueError("unexpected tree description")
            out[at].update(feature=int(m[1]), threshold=float(m[2]), left=left, right=read())
        elif not line.startswith("Predict:"):
            raise ValueError(f"unexpected tree description: {line}")
        return at

    read()
    return out


def _set_values(nodes: list[dict], sums: dict[int, tuple[float, float]]) -> list[float]:
    """Leaf values from (gradient, hessian) sums by leaf number; inner nodes get the step that they would take as leaves.

    Returns the leaves' values in their order.
    """
    leaves, total = [], {}
    for n in nodes:
        if n["left"] < 0:
            total[n["node"]] = sums.get(len(leaves), (0.0, 0.0))
            leaves.append(n["node"])
    for n in reversed(nodes):  # children follow their parent
        if n["left"] >= 0:
            a, b = total[n["left"]], total[n["right"]]
            total[n["node"]] = (a[0] + b[0], a[1] + b[1])
        g, h = total[n["node"]]
        n["value"] = g / (h + L2)
    return [nodes[i]["value"] for i in leaves]


def _probabilities(margins: Sequence[Column]) -> list[Column]:
    if len(margins) == 1:
        return [1 / (1 + F.exp(-margins[0]))]
    top = F.greatest(*margins)
    parts = [F.exp(m - top) for m in margins]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def _known(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING))


def _start(rows: DataFrame, outputs: int, weight: str) -> tuple[float, ...]:
    """Margins of the weighted class rates (one output: log odds); of the plain rates if all weights are zero."""
    found = rows.groupBy("_y").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).collect()
    weighed = any(r["w"] for r in found)
    got = {int(r["_y"]): float(r["w"] if weighed else r["n"]) for r in found}
    total = sum(got.values())
    rate = lambda k: min(max(got.get(k, 0.0) / total, 1e-6), 1 - 1e-6)
    return (float(np.log(rate(1) / (1 - rate(1)))),) if outputs == 1 else tuple(float(np.log(rate(k))) for k in range(outputs))


def _by_round(state: DataFrame, outputs: int) -> list[float]:
    """The metric after every round of the block that ``state`` ends: PR-AUC, or minus the log loss. Larger is better."""
    rows = state.where("_val").select("_y", F.posexplode("_stage").alias("round", "m"))
    p = _probabilities([F.col("m")[k] for k in range(outputs)])
    if outputs == 1:
        got = metrics.pr_auc(rows.select("_y", "round", (F.round(p[0] * BINS) / BINS).alias("s")), "_y", "s", ["round"])
        return [r[1] for r in sorted(got.collect())]
    own = sum((F.when(F.col("_y") == k, p[k]).otherwise(F.lit(0.0)) for k in range(outputs)), F.lit(0.0))
    got = rows.groupBy("round").agg(F.avg(F.log(F.greatest(own, F.lit(1e-15)))).alias("v"))
    return [r[1] for r in sorted(got.collect())]


def best_round(history: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds to keep, whether ``patience`` rounds passed without a better one); the first of equal rounds counts."""
    best = -1
    for i, v in enumerate(history):
        if best < 0 or v > history[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], params: BoostParams = BoostParams(),
        validation: str | None = None, patience: int = 50, weight: Column | None = None, block: int = BLOCK,
        part_rows: int | None = None) -> Boosted:
    """Boost trees on ``features``; two ``classes`` give one output, more one output a class.

    ``validation`` names a boolean column: its rows don't train but end the boosting, and the best round is kept; without it (or without such
    rows) all ``params.max_iter`` rounds are. ``weight`` weighs training rows. Rows whose label is none of ``classes`` are left out;
    null and NaN features count as ``MISSING``. Row samples are drawn by a hash of a written row number. With
    fewer than two classes among the training rows the model has no trees. ``part_rows``: rows a task of the rounds takes at least, where the table has
    more tasks; MLlib's sums and, over 10,000 rows, its candidate thresholds depend on the tasks, so models can differ as between numbers of cores.
    """
    ship_package(df.sparkSession)
    feats, classes = list(features), [int(c) for c in classes]
    outputs = 1 if len(classes) == 2 else len(classes)
    number = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, i))), F.col(label).cast("int"))
    val = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    asm = VectorAssembler(inputCols=feats, outputCol="_x", handleInvalid="keep")
    base = df.where(F.col(label).isin(classes)).select(
        *[_known(c).alias(c) for c in feats], number.cast("double").alias("_y"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"), val.alias("_val"), F.monotonically_increasing_id().alias("_row"))
    state = materialize(asm.transform(base).select("_row", "_x", "_y", "_w", "_val"))
    parts = max(1, -(-state.count() // part_rows)) if part_rows else None
    state = state.coalesce(parts) if parts else state
    train = state.where("not _val")
    known = train.agg(F.count_distinct("_y"), F.count(F.lit(1))).first()
    start = _start(train, outputs, "_w") if known[1] else (0.0,) * outputs
    model = Boosted(tuple(feats), tuple(classes), params.step_size, start, pd.DataFrame(columns=NODE_COLUMNS), 0,
                    "pr_auc" if outputs == 1 else "neg_log_loss")
    if known[0] < 2:
        return model
    held = bool(state.where("_val").limit(1).count())
    m = [f"_m{k}" for k in range(outputs)]
    state = state.select("*", *(F.lit(v).alias(c) for v, c in zip(start, m)), F.lit(0).alias("_round"))
    found: list[pd.DataFrame] = []
    done = 0
    while done < params.max_iter:
        kept = state.persist()  # a lost part is computed again from the written table
        now = state.withColumn("_stage", F.array().cast("array<array<double>>"))
        for r in range(done, min(done + block, params.max_iter)):
            now, leafed, nodes = _one_round(now, m, r, params)
            kept.unpersist()
            kept = leafed
            found.append(nodes)
            now = now.withColumn("_stage", F.when(F.col("_val"), F.concat("_stage", F.array(F.array(*m))))).withColumn("_round", F.col("_round") + 1)
        done = min(done + block, params.max_iter)
        written = materialize(now)
        kept.unpersist()
        state = written.drop("_stage")
        state = state.coalesce(parts) if parts else state
        if held:
            model.history += _by_round(written, outputs)
            keep, over = best_round(model.history, patience)
            if over:
                break
    model.nodes, model.rounds = pd.concat(found, ignore_index=True)[NODE_COLUMNS], done
    return model.upto(best_round(model.history, patience)[0]) if held else model


def _one_round(now: DataFrame, m: Sequence[str], r: int, params: BoostParams) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """One tree an output, leaves re-estimated; the rows with their new margins, the persisted rows with their leaves that these read,
    and the round's nodes.

    The round's number is a column: as a literal it would be compiled into every stage, and each round would run code that is new to the JVM."""
    p = _probabilities([F.col(c) for c in m])
    goal = [F.col("_y")] if len(m) == 1 else [(F.col("_y") == k).cast("double") for k in range(len(m))]
    taken = F.pmod(F.xxhash64(F.lit(params.seed), "_round", "_row"), F.lit(1 << 20)) < F.lit(int(params.subsample * (1 << 20)))
    drawn = ~F.col("_val") & taken
    sample = now.where(drawn)

    def grow(k: int):
        rows = sample.select("_x", "_w", (goal[k] - p[k]).alias("_r"))
        forest = RandomForestRegressor(featuresCol="_x", labelCol="_r", weightCol="_w", numTrees=1, bootstrap=False, maxDepth=params.max_depth,
                                       featureSubsetStrategy=params.feature_subset, seed=params.seed + 31 * r + k)
        return forest.fit(rows).trees[0]
    trees = side_by_side(now.sparkSession, [lambda k=k: grow(k) for k in range(len(m))])
    leafed, at = now, []
    for k, tree in enumerate(trees):
        leafed = tree.setFeaturesCol("_x").setPredictionCol(f"_p{k}").setLeafCol(f"_leaf{k}").transform(leafed).drop(f"_p{k}")
        leafed = leafed.withColumn(f"_leaf{k}", F.col(f"_leaf{k}").cast("int"))
        at.append(F.struct(F.lit(k).alias("k"), F.col(f"_leaf{k}").alias("leaf"),
                           (F.col("_w") * (goal[k] - p[k])).alias("g"), (F.col("_w") * p[k] * (1 - p[k])).alias("h")))
    sums: dict[int, dict[int, tuple[float, float]]] = {k: {} for k in range(len(m))}
    leafed = leafed.persist()
    each = F.explode(F.array(*at)) if len(at) > 1 else at[0]
    for s in leafed.where(drawn).select(each.alias("a")).groupBy("a.k", "a.leaf").agg(F.sum("a.g").alias("g"), F.sum("a.h").alias("h")).collect():
        sums[s["k"]][s["leaf"]] = (s["g"], s["h"])
    now, parts = leafed, []
    for k, tree in enumerate(trees):
        nodes = tree_nodes(tree.toDebugString)
        steps = ", ".join(f"double('{params.step_size * v!r}')" for v in _set_values(nodes, sums[k]))
        step = F.element_at(F.expr(f"array({steps})"), F.col(f"_leaf{k}") + 1)
        now = now.withColumn(m[k], F.col(m[k]) + step).drop(f"_leaf{k}")
        parts.append(pd.DataFrame(nodes).assign(round=r, cls=k))
    return now, leafed, pd.concat(parts, ignore_index=True)


def _arrays(model: Boosted) -> list[tuple[int, int, dict[str, np.ndarray]]]:
    """(round, output, columns of the tree by node number) of all trees in order."""
    out = []
    for (r, k), g in model.nodes.groupby(["round", "cls"]):
        g = g.sort_values("node")
        out.append((int(r), int(k), {c: g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value")}))
    return out


def _walk(x: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """The leaf value of every row of ``x``."""
    node = np.zeros(len(x), np.int64)
    live = np.flatnonzero(t["left"][node] >= 0)
    while len(live):
        at = node[live]
        left = x[live, t["feature"][at]] <= t["threshold"][at]
        node[live] = np.where(left, t["left"][at], t["right"][at])
        live = live[t["left"][node[live]] >= 0]
    return t["value"][node]


def raw_margins(x: np.ndarray, model: Boosted, trees=None) -> np.ndarray:
    """(rows, outputs) margins of a numpy batch."""
    out = np.tile(np.array(model.base), (len(x), 1))
    for _, k, t in trees if trees is not None else _arrays(model):
        out[:, k] += model.step_size * _walk(x, t)
    return out


def staged_margins(x: np.ndarray, model: Boosted) -> np.ndarray:
    """(rounds, rows, outputs): the margins after every round."""
    out = np.tile(np.array(model.base), (model.rounds, len(x), 1))
    for r, k, t in _arrays(model):
        out[r:, :, k] += model.step_size * _walk(x, t)
    return out


def margins(model: Boosted, df: DataFrame, out: str = "margins", staged: bool = False) -> DataFrame:
    """``df`` with the model's margins, array<double> by output; ``staged``: an array of these, after every round, from one pass."""
    ship_package(df.sparkSession)
    feats, trees = list(model.features), _arrays(model)
    kind = ArrayType(ArrayType(DoubleType())) if staged else ArrayType(DoubleType())
    schema = StructType([*df.schema.fields, StructField(out, kind)])
    inputs = [f"_f{i}" for i in range(len(feats))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[inputs].to_numpy(dtype="float64")
            pdf = pdf.drop(columns=inputs)
            pdf[out] = list(staged_margins(x, model).transpose(1, 0, 2).tolist()) if staged else list(raw_margins(x, model, trees))
            yield pdf
    return df.select("*", *(_known(c).alias(i) for c, i in zip(feats, inputs))).mapInPandas(run, schema)


def score_binary(model: Boosted, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``df`` with ``p_failure`` and ``pred_binary`` (1.0 at ``threshold`` or more)."""
    p = _probabilities([F.col("_margins")[0]])[0]
    return (margins(model, df, "_margins").withColumn("p_failure", p).withColumn("pred_binary", (F.col("p_failure") >= threshold).cast("double"))
            .drop("_margins"))


def score_multiclass(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with class probabilities ``probs`` (sum 1), ``risk_class`` (argmax) and ``failure_probability``."""
    from ..operators.risk import argmax_class, failure_probability
    out = margins(model, df, "_margins").withColumn("probs", F.array(*_probabilities([F.col("_margins")[k] for k in range(model.outputs)]))).drop("_margins")
    return out.withColumn("risk_class", argmax_class(F.col("probs"))).withColumn("failure_probability", failure_probability(F.col("probs")))


def train_binary(df: DataFrame, features: Sequence[str], label: str = "target_binary", params: BoostParams = BoostParams(),
                 validation: str | None = None, patience: int = 50, part_rows: int | None = None) -> Boosted:
    """ML1/ML3: binary model, positives weighed by negatives / positives of the training rows (AG7), stopped on PR-AUC."""
    own = df.where(~F.col(validation)) if validation else df
    c = own.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    scale = F.when(F.col(label) == 1, F.lit(float(c["neg"] / max(c["pos"], 1)))).otherwise(F.lit(1.0))
    return fit(df, features, label, (0, 1), params, validation, patience, scale, part_rows=part_rows)


def train_multiclass(df: DataFrame, features: Sequence[str], label: str = "target_multiclass", params: BoostParams = BoostParams(),
                     classes: Sequence[int] = (0, 1, 2), balanced: bool = False, validation: str | None = None, patience: int = 50,
                     part_rows: int | None = None) -> Boosted:
    """ML2/ML3: one joint softmax model, stopped on log loss; ``balanced`` weighs rows by class (AG8)."""
    weight = None
    if balanced:
        own = df.where(~F.col(validation)) if validation else df
        by = {r["class"]: r["weight"] for r in class_weights(own, label).collect()}  # a row a class
        weight = sum((F.when(F.col(label) == k, F.lit(float(by.get(k, 0.0)))).otherwise(F.lit(0.0)) for k in classes), F.lit(0.0))
    return fit(df, features, label, classes, params, validation, patience, weight, part_rows=part_rows)


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    """SRC10: nodes as parquet and the rest as a JSON line below ``path``; the JSON, written last, makes the model complete."""
    meta = asdict(replace(model, nodes=None))
    rows = model.nodes.astype({c: "float64" if c in ("threshold", "value") else "int64" for c in NODE_COLUMNS})
    kinds = ", ".join(f"{c} {'double' if c in ('threshold', 'value') else 'long'}" for c in NODE_COLUMNS)
    spark.createDataFrame(rows.to_dict("records"), kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Boosted:
    """A model written by ``save``; its nodes are bounded by rounds, classes and depth."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["round", "cls", "node"]).reset_index(drop=True)[NODE_COLUMNS]
    return Boosted(**(meta | {"nodes": nodes, "features": tuple(meta["features"]), "classes": tuple(meta["classes"]), "base": tuple(meta["base"])}))
