"""SimHash near-dedup (operator 4): pigeonhole blocks, block join, Hamming verification, components.

Fingerprints that differ in at most d bits, cut into b blocks, agree in at least b - d blocks. So close pairs
share one of the C(b, b - d) keys made of b - d blocks; pairs meet on these keys only, and are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, join_lookup, raw_texts, runs, split_hot, stash, text_steps
from .components import components

SEED = 42
BITS = 64
STEP = 200_000  # shingles whose bits are unpacked at a time
PIECE = 4096  # fingerprints of one key that meet in a task


def fingerprint(words: list[bytes], shingle: int) -> int:
    """The SimHash of one text's lower-cased words."""
    return int(_fingerprints([words], shingle)[0])


def _fingerprints(docs: list[list[bytes]], shingle: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' XXH64; without words, zero."""
    h, seed = xxhash.xxh64_intdigest, SEED
    hashes: list[int] = []
    counts = []
    for words in docs:
        joined = b" ".join(words)
        n = len(words) - shingle + 1
        if n > 1:
            ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words)))
            starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
            hashes.extend([h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())])
            counts.append(n)
        elif words:
            hashes.append(h(joined, seed))
            counts.append(1)
        else:
            counts.append(0)
    counts = np.array(counts, np.int64)
    values = np.array(hashes, "<u8")
    ones = np.zeros((len(docs), BITS), np.int64)
    owner = np.repeat(np.arange(len(docs)), counts)
    for lo in range(0, len(values), STEP):
        bits = np.unpackbits(values[lo:lo + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[lo:lo + STEP]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    set_ = 2 * ones > counts[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()


def _versions() -> list[Column]:
    """Two hashes of a row's text: with the doc_id they name it among rows that repeat the id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), F.reverse(text)).alias("t2")]


def fingerprints(docs: DataFrame, shingle: int = 4, versions: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row; words are lower-cased in A-Z and split at ASCII white space. ``versions``: t1, t2 too."""
    more = _versions() if versions else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            fps = _fingerprints([t.lower().split() for t in raw_texts(b)], shingle)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
            .mapInArrow(run, "doc_id long, fp long" + (", t1 long, t2 long" if versions else "")))


def block_count(fingerprints_: int, max_bits: int) -> int:
    """Blocks whose keys are long enough that random fingerprints seldom meet: a key's bits are about log2 of their number or more."""
    blocks = max_bits + 2
    while BITS * (blocks - max_bits) // blocks < np.log2(max(2, fingerprints_)) and blocks < 24:
        blocks += 1
    return blocks


def block_keys(blocks: int, max_bits: int):
    """SQL expression: the array of a fingerprint's keys (hashes of the combination's number and its blocks' bits)."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    return F.array(*(F.xxhash64(F.lit(n), *(parts[i] for i in combo)) for n, combo in enumerate(combinations(range(blocks), blocks - max_bits))))


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (to verified neighbours) that connect what pairs within ``max_bits`` connect.

    Breadth first: a fingerprint reached is compared only with those not yet reached, so a dense group costs
    about its size, not its square.
    """
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= max_bits
            if near.any():
                out += [(i, j) for j in left[near].tolist()]
                queue += left[near].tolist()
                left = left[~near]
    return out


def links(fps: DataFrame, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (a, b) that connect all pairs within ``max_bits``; each edge is such a pair."""
    fps = fps.select("fp")
    blocks = blocks or block_count(fps.count(), max_bits)
    keyed = split_hot(fps.select("fp", F.explode(block_keys(blocks, max_bits)).alias("key")), ["key"], "fp", PIECE)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, cols in runs(batches, ["key", "piece_a", "piece_b"], ["fp"]):
            fp = cols["fp"].to_numpy().view(np.uint64)
            size = np.diff(at)
            two = at[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            a, b = [fp[near]], [fp[near + 1]]
            for lo, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
                group = fp[lo:lo + n]
                if edges := forest(group, max_bits):
                    i, j = np.array(edges).T
                    a.append(group[i])
                    b.append(group[j])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return by_group(keyed.select("key", "piece_a", "piece_b", "fp"), ["key", "piece_a", "piece_b"], ["fp"], search, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows of equal fingerprint are one node, so copies cost a
    count, not pairs. Repeated doc_ids come back as often as they are there; a null doc_id links but is never the
    smallest (a component of null ids alone has component_id null). An empty table gives an empty one; other columns are not read.
    """
    fps = stash(fingerprints(docs, shingle), "simhash")
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "simhash-nodes")
    ids = stash(_least(nodes, "first", max_bits, blocks), "simhash-least")
    return (join_lookup(fps, ids.select("fp", F.col("least").alias("component_id"), F.col("rows").alias("_n")), "fp", fps.count())
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def _least(nodes: DataFrame, name: str, max_bits: int, blocks: int | None) -> DataFrame:
    """``nodes`` (a row a fingerprint) with ``least``, the least ``name`` of the component. Fingerprints without a link don't move."""
    comp = components(links(nodes, max_bits, blocks)).withColumnRenamed("node", "fp")
    named = stash(nodes.join(comp, "fp", "left"), "simhash-named")
    linked = named.where("component is not null")
    low = linked.groupBy("component").agg(F.min(name).alias("least"), F.count(F.lit(1)).alias("_n"))
    alone = named.where("component is null").withColumn("least", F.col(name))
    return alone.unionByName(join_lookup(linked, low, "component", linked.count()).select(alone.columns)).drop("component")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one each; all columns stay.

    The row with the smallest doc_id stays (null ids last), of rows that repeat the id the one whose text has the smaller hash, of rows that repeat
    both the one whose columns together have the smallest hash: reruns keep the same rows.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t1", "t2")
    fps = stash(fingerprints(docs, shingle, versions=True), "simhash")
    nodes = stash(fps.groupBy("fp").agg(F.min(key).alias("first")), "simhash-nodes")
    first = _least(nodes, "first", max_bits, None).select("least.*").distinct()
    mark = [f"_{k}" for k in range(4)]
    while set(mark) & {c.lower() for c in docs.columns}:
        mark = [c + "_" for c in mark]
    values = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), *_versions()]
    rows = docs.select("*", *(v.alias(c) for v, c in zip(values, mark)))
    whole = F.xxhash64(*(F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema))
    # a task drops what repeats among its own rows before the texts move
    one = rows.withColumn(mark[0] + "r", F.row_number().over(Window.partitionBy(*mark).orderBy(whole))).where(F.col(mark[0] + "r") == 1)
    return one.join(first.toDF(*mark), mark, "left_semi").select(*docs.columns)
