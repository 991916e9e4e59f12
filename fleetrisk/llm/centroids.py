"""Centroid clustering (operator 13): exact integer k-means with scalar lookup tables.

Vectors become integers and are written once as blocks: per dimension the integer values that occur in the block, and each
vector's place among them. In a round a task tabulates the squared difference of every dimension, occurring value and
centroid, and a distance is a sum of 64 gathers from that table. All sums are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Vectors of a block; a place among its values fits 16 bits.
BLOCK = 4096
#: Integer components of at most this size keep squared distances within 64 bits.
LARGEST = 2 ** 27
_BLOCKS = "ids array<long>, starts array<int>, values array<long>, codes binary"


def _encode(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).T
                found = [np.unique(row, return_inverse=True) for row in x]
                starts = np.cumsum([0] + [len(v) for v, _ in found])
                codes = np.concatenate([c.astype(np.uint16).ravel() for _, c in found]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([starts.tolist()], pa.list_(pa.int32())),
                                                  pa.array([np.concatenate([v for v, _ in found])], pa.list_(pa.int64())), pa.array([codes], pa.binary())],
                                                 names=["ids", "starts", "values", "codes"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[tuple]:
    """Per block: ids, values by dimension and vector, nearest centroid, squared distance."""
    dims = centers.shape[1]
    for b in batches:
        for k in range(b.num_rows):
            ids = b.column("ids")[k].values
            starts, values = (b.column(c)[k].values.to_numpy() for c in ("starts", "values"))
            at = np.frombuffer(b.column("codes")[k].as_buffer(), np.uint16).reshape(dims, -1) + starts[:-1, None]
            dim = np.repeat(np.arange(dims), np.diff(starts))
            table = (values[:, None] - centers.T[dim]) ** 2  # occurring value of a dimension x centroid
            far = table[at[0]]
            for row in at[1:]:
                far += table[row]
            near = far.argmin(axis=1)  # ties: the smaller number
            yield ids, values[at], near, far[np.arange(len(near)), near]


def _round(blocks: DataFrame, centers: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """cluster -> (vectors, inertia, sums by dimension), combined in the tasks; k x dims numbers reach the driver."""
    k, dims = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, inertia = np.zeros((k, dims + 1), np.int64), [0] * k
        for _, x, near, far in _blocks(batches, centers):
            for c in np.unique(near).tolist():
                own = near == c
                sums[c, :dims] += x[:, own].sum(axis=1)
                sums[c, dims] += own.sum()
                inertia[c] += (int((far[own] >> 32).sum()) << 32) + int((far[own] & 0xFFFFFFFF).sum())  # may leave 64 bits
        met = np.flatnonzero(sums[:, dims])
        totals = [t for c in met for t in (*sums[c].tolist(), inertia[c])]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(met, dims + 2), pa.int32()), pa.array(np.tile(np.arange(dims + 2), len(met)), pa.int32()),
                                          pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))], names=["cluster", "part", "total"])

    rows = blocks.mapInArrow(run, "cluster int, part int, total decimal(38,0)").groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r.cluster, {})[r.part] = int(r.total)
    return {c: (p[dims], p[dims + 1], [p[d] for d in range(dims)]) for c, p in out.items()}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia) of the kept vectors, and the final centroids as integers.

    Kept are vectors with exactly ``dims`` components, none null or non-finite, as integers floor(``scale`` x); a vector with an integer
    component beyond ``LARGEST`` is left out as well, as its distances would not fit 64 bits. Centroids start as the ``k`` vectors with the smallest
    hex sha256 of "``seed``:vec_id" (ties by components; null ids last); with fewer vectors there are fewer centroids. An inertia that leaves 64 bits is null.
    Every round assigns each vector to the nearest centroid (ties: the smaller number) and replaces every centroid that has vectors by the floor of
    their exact mean. Rows that repeat a vec_id are vectors of their own; an empty table gives an empty one and no centroids; other columns are not read.
    """
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda v: F.floor(v * scale))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v * scale) > LARGEST)
    kept = (vectors.where((F.size(x) == dims) & ~F.exists(x, bad)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("v")))
    first = (kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
             .orderBy(F.asc_nulls_last("h"), "v").limit(k).collect())
    if not first:
        empty = vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long")
        return empty, []
    centers = [list(r.v) for r in first]
    blocks = stash(kept.mapInArrow(_encode(dims), _BLOCKS), "vector-blocks")
    for _ in range(rounds):
        for c, (n, _, sums) in _round(blocks, np.array(centers, np.int64)).items():
            centers[c] = [s // n for s in sums]
    at = np.array(centers, np.int64)
    parts = {c: inertia for c, (_, inertia, _) in _round(blocks, at).items()}
    long = lambda i: i if i < 2 ** 63 else None
    total, own = long(sum(parts.values())), [long(parts.get(c, 0)) for c in range(len(centers))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, near, far in _blocks(batches, at):
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(far, pa.int64()), pa.array([own[c] for c in near.tolist()], pa.int64()),
                                              pa.array([total] * len(near), pa.int64())], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia"])

    return blocks.mapInArrow(assign, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"), centers


def digest(center: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, center)).encode()).hexdigest()


def cluster_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The DuckDB twin of the query: one assignment and one mean a round."""
    near = """a{i} AS MATERIALIZED (SELECT n, vec_id, v, arg_min(c, (far, c)) AS c, min(far) AS far FROM (
  SELECT k.n, k.vec_id, k.v, m.c, list_sum(list_transform(list_zip(k.v, m.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM k, m{i} m) GROUP BY n, vec_id, v)"""
    mean = """m{j} AS MATERIALIZED (SELECT c, coalesce(x.m, m{i}.m) AS m FROM m{i} LEFT JOIN (
  SELECT c, list((s - ((s % q) + q) % q) // q ORDER BY d) AS m FROM (SELECT c, d, CAST(sum(v[d]) AS BIGINT) AS s, count(*) AS q FROM a{i}, range(1, {dims} + 1) t(d) GROUP BY c, d) GROUP BY c) x USING (c))"""
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS m FROM k ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""]
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, j=i + 1, dims=dims)]
    steps.append(near.format(i=rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} m ON a.c = m.c"""
