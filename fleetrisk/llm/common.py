"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

#: Bytes of text that one step inside a task handles at a time (a longer text is a step of its own).
STEP_BYTES = 2_000_000
#: Bytes of an Arrow batch that goes to Python, a few steps. Spark's own bound is rows: 10,000 texts of any length, held by the executor and its worker.
BATCH_BYTES = 4_000_000


def prepare(spark: SparkSession) -> None:
    """Shared folder known, package on the workers, Arrow batches bounded by ``BATCH_BYTES`` (a bound that the session has stays)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, tag: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and go on from the written table.

    The lineage ends there, so a lost executor costs a reread and never a
    recomputation, and what reads the table twice sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{tag}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text",
               step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``step_bytes`` of text, so memory
    follows one slice (or one long text), not a whole batch."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64))
        lo = 0
        while lo < b.num_rows:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + step_bytes, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return pc.fill_null(batch.column(column).cast(pa.string()), "").to_pylist()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "").cast(pa.binary()).to_pylist()


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], fields: Sequence[str],
         max_rows: int = 200_000) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
    """Whole runs of equal ``keys`` from sorted batches.

    Yields (start offsets of the runs plus the end, columns). Rows are held
    only until their run ends; callers bound the length of a run before.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def out(t: pa.Table, at: np.ndarray):
        return np.append(at, t.num_rows), {f: t.column(f).combine_chunks() for f in fields}

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < max_rows:
            continue
        t = pa.Table.from_batches(held)
        at = cut(t)
        if len(at) > 1:
            done = t.slice(0, int(at[-1]))
            yield out(done, at[:-1])
            held = t.slice(int(at[-1])).combine_chunks().to_batches()
            rows = t.num_rows - int(at[-1])
        else:
            held = [t.combine_chunks().to_batches()[0]]
            rows = 0  # look again after as many rows more
    if held:
        t = pa.Table.from_batches(held)
        yield out(t, cut(t))


def split_hot(df: DataFrame, keys: Sequence[str], salt: str, most: int) -> DataFrame:
    """Groups with at least two rows, cut so that no task gets more than about ``2 * most`` rows.

    A group of n rows is dealt by a hash of ``salt`` into g = ceil(n / most)
    pieces, and each pair of pieces (``piece_a`` <= ``piece_b``) becomes a group of its
    own; ``piece`` is a row's own piece. So every pair of rows meets in a bounded
    task. Counts are combined before the shuffle; only groups over ``most`` are copied.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cut = (df.join(sizes, keys)
           .withColumn("_g", F.ceil(F.col("_n") / F.lit(most)).cast("int"))
           .withColumn("piece", F.pmod(F.xxhash64(salt), F.col("_g")).cast("int"))
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))))
    return (cut.withColumn("piece_a", F.least("piece", "_other")).withColumn("piece_b", F.greatest("piece", "_other"))
            .drop("_n", "_g", "_other"))


#: Hot keys that ``join_lookup`` broadcasts at most, and rows of a key up to which it isn't hot at any size.
MOST_HOT, LEAST_HOT = 100_000, 1_000


def join_lookup(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, a row a key with ``_n``, the number of ``rows`` that have it; ``total``: at least the number of rows.

    Keys with more than a ``MOST_HOT``-th of all rows (and more than ``LEAST_HOT``) are few, by counting, so they are broadcast and
    their rows stay where they are; the others meet by a shuffle.
    """
    limit = max(LEAST_HOT, total // MOST_HOT)
    if total <= limit:
        return rows.join(table.drop("_n"), key)
    hot = F.broadcast(table.where(F.col("_n") > limit).drop("_n"))
    rest = rows.join(F.broadcast(table.where(F.col("_n") > limit).select(key)), key, "left_anti")
    both = rest.join(table.where(F.col("_n") <= limit).drop("_n"), key)
    return rows.join(hot, key).select(both.columns).unionByName(both)


def by_group(df: DataFrame, keys: Sequence[str], within: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """Run ``fn`` (Arrow batches to Arrow batches) over partitions that hold whole groups, sorted."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *within).mapInArrow(fn, schema)
