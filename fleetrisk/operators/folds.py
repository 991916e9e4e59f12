"""Validation splits as columns: walk-forward folds, positional hold-out, stratified folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunking as ch
from .ranking import global_positions, shuffle_order, time_positions


def _positioned_with_n(df: DataFrame, pos: str, order: str = "entity") -> DataFrame:
    """Global positions plus the table's row count (a scalar, attached as a literal)."""
    n = df.count()
    d = df if pos in df.columns else {"entity": global_positions, "time": time_positions}[order](df, out=pos)
    return d.withColumn("_total", F.lit(n).cast("long"))


def walk_forward_folds(df: DataFrame, n_splits: int = 5, pos: str = "row_pos", order: str = "entity") -> DataFrame:
    """ML6: expanding-window folds by row position.

    ``order="entity"``: rows by (inverter, time), as the reference's table lies; ``order="time"``: all rows by time, so a fold trains
    on the past of all inverters (see ``with_purge``).

    With n rows and t = n // (n_splits + 1), fold i (0-based) tests positions
    [n - (n_splits - i) * t, n - (n_splits - 1 - i) * t) and trains on every
    earlier position. Adds ``test_fold`` (NULL outside every test block) and
    ``fold_test_start`` (start of the row's test block).
    """
    d = _positioned_with_n(df, pos, order)
    t = F.floor(F.col("_total") / (n_splits + 1))
    first = F.col("_total") - t * n_splits
    fold = F.when((t > 0) & (F.col(pos) >= first), F.floor((F.col(pos) - first) / t)).cast("int")
    return d.select(*[c for c in d.columns if c != "_total"], fold.alias("test_fold"))


def with_purge(folded: DataFrame, horizon_hours: int = 168, time: str = "datetime", pos: str = "row_pos") -> DataFrame:
    """``folded`` (folds in time order) with ``trains_from`` and ``purged_from``: a fold trains on the rows whose label's horizon
    ends before its test block begins, and the rows before the block that don't are purged.

    Both are fold numbers: a row is in the training set of fold k if ``trains_from`` <= k, purged from it if ``purged_from`` <= k < ``trains_from``,
    and later than its begin otherwise; null where there is no such fold. One row a fold reaches the driver.
    """
    blocks = {r.test_fold: (r.pos, r.time) for r in folded.where("test_fold is not null").groupBy("test_fold")
              .agg(F.min(pos).alias("pos"), F.min(time).alias("time")).collect()}
    first = lambda cond: F.coalesce(*(F.when(cond(k, *blocks[k]), F.lit(k)) for k in sorted(blocks))) if blocks else F.lit(None).cast("int")
    ends = F.col(time) + F.expr(f"INTERVAL {int(horizon_hours)} HOURS")
    trains = first(lambda k, p, t: (F.col(pos) < p) & (ends <= F.lit(t)))
    before = first(lambda k, p, t: F.col(pos) < p)
    return folded.withColumn("trains_from", trains.cast("int")).withColumn(
        "purged_from", F.when(F.coalesce(before < trains, before.isNotNull()), before).cast("int"))


def holdout_split(df: DataFrame, train_fraction: float = 0.8, pos: str = "row_pos") -> DataFrame:
    """ML7: the first int(train_fraction * n) positions train, the rest test."""
    d = _positioned_with_n(df, pos)
    cut = F.floor(F.lit(float(train_fraction)) * F.col("_total"))
    return d.select(*[c for c in d.columns if c != "_total"], (F.col(pos) < cut).alias("is_train"))


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], n_splits: int = 5, seed: int = 42,
                     digits: int = 4) -> DataFrame:
    """ML8: shuffled stratified folds; per class, fold sizes differ by at most one.

    Rows of each class are ordered by the md5 of their key and the seed (``ranking.shuffle_order``) and dealt
    round-robin into folds. The per-class rank comes from prefix sums over the order's first ``digits`` hex
    digits (16^digits buckets), so a dominant class is still ranked by many tasks.
    """
    d = df.withColumn("_h", shuffle_order(keys, seed))
    bucket = F.conv(F.substring("_h", 1, digits), 16, 10).cast("long")
    ranked = ch.add_positions(d, key=label, order="_h", tiebreak=list(keys), bucket=bucket)
    return ranked.withColumn("fold", (F.col(ch.POS) % n_splits).cast("int")).drop("_h", ch.POS)
