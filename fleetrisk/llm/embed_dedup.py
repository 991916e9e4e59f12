"""Embedding near-dedup (operator 7): pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order (Chavez, Figueroa and Navarro, TPAMI 2008;
inverted lists after Amato and Savino, 2008). Vectors that share at least ``shared`` of their ``prefix`` nearest pivots are candidates, and
their cosine is then computed in double precision. Pivots have a common order, those that are near to few others first; two vectors that
share that many have one in common among the first ``prefix`` - ``shared`` + 1 of each, so only these lists are kept, and a pair is looked at in
the list of the first pivot that both have.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, runs, split_hot, stash
from .components import components

PIECE = 1024  # vectors of one list that meet in a task: pieces of a longer list meet pairwise
#: Pivots a task holds: twice the square root of the number of vectors stays below it up to 2.6 x 10^8 vectors of a length.
MAX_PIVOTS = 32_768


def pivot_count(vectors: int) -> int:
    """About twice the square root of the number of vectors, so that a list's length grows as slowly; at most ``MAX_PIVOTS``."""
    return int(min(MAX_PIVOTS, max(16, 2 * vectors ** 0.5)))


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(embedding):
    """Not null or empty, no null, infinite or NaN component, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _assign(reps: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    shared = reps.sparkSession.sparkContext.broadcast(pickle.dumps(pivots))  # at most MAX_PIVOTS vectors, in their common order
    kind = reps.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = pickle.loads(shared.value)
        k = min(prefix, len(ref))
        for b in batches:
            if b.num_rows:
                near = unit(_matrix(b.column("embedding"))) @ ref.T
                top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, top.size + 1, k, dtype=np.int32), top.astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "n", "label", "embedding")), lists],
                                                 names=["rep", "n", "label", "embedding", "pivots"])

    return reps.select("rep", "n", "label", "embedding").mapInArrow(
        run, f"rep long, n long, label string, embedding {kind}, pivots array<int>")


def _pivots(own: DataFrame, m: int, count: int, prefix: int) -> np.ndarray:
    """``m`` of the distinct vectors by hash, those first that are among the ``prefix`` nearest of the fewest others."""
    spots = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(1), "h1"), F.lit(spots)) < F.lit(int(min(1.0, (2 * m + 100) / count) * spots))  # about twice as many come to the driver
    rows = own.where(draw).orderBy(F.xxhash64(F.lit(1), "h1"), "h1", "h2").limit(m).select("embedding").collect()
    x = unit(np.array([r.embedding for r in rows]))
    near = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 1024):
        close = x[lo:lo + 1024] @ x.T
        k = min(prefix + 1, len(x))  # each is its own nearest
        near += np.bincount(np.argpartition(-close, k - 1, axis=1)[:, :k].ravel(), minlength=len(x))
    return x[np.argsort(near, kind="stable")]


def _pairs(lists: DataFrame, shared: int, least: float) -> DataFrame:
    """Within each list: (rep, links, root): verified links counted once over all lists, and local components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, c in runs(batches, ["label", "pivot", "piece_a", "piece_b"],
                          ["rep", "n", "embedding", "pivots", "pivot", "piece", "piece_a", "piece_b"], max_rows=8_000):
            rep, n, piece = (c[k].to_numpy() for k in ("rep", "n", "piece"))
            first, a_, b_ = (c[k].to_numpy() for k in ("pivot", "piece_a", "piece_b"))
            x, own = unit(_matrix(c["embedding"])), _matrix(c["pivots"])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                if hi - lo < 2:
                    continue
                known, local = np.unique(own[lo:hi], return_inverse=True)
                has = np.zeros((hi - lo, len(known)), np.float32)
                np.put_along_axis(has, local.reshape(hi - lo, -1), 1, axis=1)
                p = int(np.searchsorted(known, first[lo]))
                # candidates: enough pivots in common, met here first
                pair = (has @ has.T >= min(shared, own.shape[1])) & (has[:, :p] @ has[:, :p].T == 0)
                if a_[lo] != b_[lo]:
                    pair &= piece[lo:hi, None] != piece[None, lo:hi]
                np.fill_diagonal(pair, False)
                i, j = np.nonzero(np.triu(pair))
                near = np.zeros(len(i), bool)
                for s in range(0, len(i), 100_000):
                    near[s:s + 100_000] = np.einsum("ij,ij->i", x[lo + i[s:s + 100_000]], x[lo + j[s:s + 100_000]]) >= least
                i, j = i[near], j[near]
                if not len(i):
                    continue
                links = np.bincount(i, n[lo + j], hi - lo) + np.bincount(j, n[lo + i], hi - lo)
                root = np.arange(hi - lo)
                while True:  # smallest row of each local component
                    low = np.minimum(root[i], root[j])
                    new = root.copy()
                    np.minimum.at(new, i, low)
                    np.minimum.at(new, j, low)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                met = np.flatnonzero(links)
                out.append((rep[lo + met], links[met].astype(np.int64), rep[lo + root[met]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col)) for col in zip(*out)], names=["rep", "links", "root"])

    keys = ["label", "pivot", "piece_a", "piece_b"]
    return by_group(lists, keys, ["rep"], run, "rep long, links long, root long")


def link_vectors(vectors: DataFrame, least: float = 0.93, prefix: int = 8, shared: int = 3, max_pivots: int | None = None) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept (vec_id is component_id).

    Vectors link if their labels are equal and not null and their cosine is at least ``least``. Unusable vectors (null, empty, zero, null or
    non-finite components) and rows without a vec_id link with nothing; vectors of unequal length don't link.
    Equal vectors of a label are one node with a count, so copies cost no pairs. Rows that
    repeat a vec_id are vectors of their own that share a component. An empty table gives an empty one. Pivots are a bounded sample
    (``pivot_count``) of the distinct vectors by hash; every vector is indexed. A pair that shares fewer than ``shared`` pivots is missed: tests hold
    the recall against brute force.
    """
    spark = vectors.sparkSession
    number = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # as it comes; cosines are in double
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                       F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    good = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    v = v.withColumn("embedding", F.when(good, F.transform("embedding", lambda x: (x + F.lit(0.0)).cast(number))))  # -0.0 is 0.0
    # two 64-bit hashes name a distinct vector of a label
    keyed = stash(v.select("vec_id", F.when(good, F.xxhash64("label", "embedding")).alias("h1"),
                           F.when(good, F.xxhash64(F.lit(7), F.reverse("embedding"), "label")).alias("h2"), "label", "embedding"), "vectors")
    groups = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = stash(groups.join(keyed.withColumnRenamed("vec_id", "rep"), ["h1", "h2", "rep"]).dropDuplicates(["h1", "h2"])
                 .select("h1", "h2", "rep", "n", "label", "embedding", F.size("embedding").alias("size")), "vector-reps")
    found = None
    for size, count in sorted((r["size"], r["count"]) for r in reps.groupBy("size").count().collect()):
        own = reps.where(F.col("size") == size)
        m = min(max_pivots or pivot_count(count), count)
        pivots = _pivots(own, m, count, prefix)
        kept = max(1, min(prefix, len(pivots)) - shared + 1)
        lists = _assign(own, pivots, prefix).select("*", F.explode(F.slice("pivots", 1, kept)).alias("pivot"))
        part = _pairs(split_hot(lists, ["label", "pivot"], "rep", PIECE), shared, least)
        found = part if found is None else found.union(part)
    found = stash(found if found is not None else spark.createDataFrame([], "rep long, links long, root long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (reps.select("h1", "h2", "rep", "n").join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
             .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")))
    return (keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
