"""Sharding (operator 10): extendible hashing with DataFrame functions only.

Rows are hashed; a directory indexed by hash-prefix bits names the shards. A bucket splits on one bit more only while it
is over the byte limit, so a shard is the shortest prefix whose rows fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Prefix bits that one round of counting looks at; buckets that are still too large get another round.
ROUND_BITS = 12
#: Bits of the key's hash; after them come bits of the row's number, which tell rows of equal keys apart.
KEY_BITS = 60
ALL_BITS = KEY_BITS + 48
#: Columns that the assignment adds.
SHARD = ["shard", "depth", "shard_bytes", "shard_rows"]


def _directory(cells: DataFrame, max_bytes: int, limit_bits: int) -> DataFrame:
    """cells (prefix, bytes, n) of one length -> (cell, prefix, bytes, n): the shortest prefix of each cell that fits, if any.

    Sizes are summed up over the cells of a round, not over rows.
    """
    length = F.length("prefix")
    sums = (cells.withColumn("cell", F.col("prefix")).withColumn("depth", F.explode(F.sequence(F.lit(0), length)))
            .where(F.col("depth") >= F.col("from"))
            .withColumn("prefix", F.expr("substring(prefix, 1, depth)")))
    fits = (sums.groupBy("prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
            .where((F.col("shard_bytes") <= max_bytes) | (F.col("shard_rows") == 1) | (F.length("prefix") >= limit_bits)))
    return (sums.select("cell", "prefix").join(fits, "prefix").groupBy("cell")
            .agg(F.min(F.struct(F.length("prefix").alias("depth"), "prefix", "shard_bytes", "shard_rows")).alias("s"))
            .select("cell", "s.prefix", "s.shard_bytes", "s.shard_rows"))


def assign_shards(docs: DataFrame, max_bytes: int, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes (of the text), shard (bit string of the prefix), depth, shard_bytes, shard_rows.

    The bits are those of md5 of the key as text; rows whose key is equal (or null: hashed as an empty text) are told apart by
    the bits of a row number, so one hot key is split like anything else. A shard over ``max_bytes`` is a single row larger than the limit. Null
    texts have 0 bytes; an empty table gives no shards; other columns are not read.
    Each round counts bytes by prefix (combined before the shuffle) and only rows of buckets still too large take part in the next.
    """
    return _assign(docs.select(F.col(key), _size().alias("n_bytes")), max_bytes, key, "n_bytes").select(key, "n_bytes", *SHARD)


def _size() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")


def _assign(read: DataFrame, max_bytes: int, key: str, size: str) -> DataFrame:
    """The rows of ``read``, all columns, with the columns ``SHARD``; none of ``read`` is named like a column used here."""
    named = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    bits = F.concat(*(F.lpad(F.conv(F.substring(named, 1 + 5 * i, 5), 16, 2), 20, "0") for i in range(KEY_BITS // 20)))
    rows = stash(read.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bits", bits), "shard-rows")
    # the bits of the row number, once written, are fixed: a rerun of a task reads the same ones
    number = F.substring(F.lpad(F.bin(F.abs(F.xxhash64("_row"))), 63, "0"), 16, ALL_BITS - KEY_BITS)
    rows = rows.withColumn("_bits", F.concat("_bits", number))
    todo, done, depth = rows, None, 0
    while depth < ALL_BITS:
        upto = min(depth + ROUND_BITS, ALL_BITS)
        placed = todo.withColumn("cell", F.substring("_bits", 1, upto))
        cells = placed.groupBy(F.col("cell").alias("prefix")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("from", F.lit(depth))
        found = stash(_directory(cells, max_bytes, ALL_BITS), "shard-directory")
        part = placed.join(found, "cell").select(*read.columns, F.col("prefix").alias("shard"), F.length("prefix").alias("depth"), "shard_bytes", "shard_rows")
        done = part if done is None else done.unionByName(part)
        over = cells.join(found.select(F.col("cell").alias("prefix")), "prefix", "left_anti")
        if over.isEmpty():
            break
        todo = stash(placed.join(found.select("cell"), "cell", "left_anti").drop("cell"), "shard-rest")
        depth = upto
    return done


def directory(shards: DataFrame) -> DataFrame:
    """One row per shard: shard, depth, shard_bytes, shard_rows."""
    return shards.select(*SHARD).distinct()


def write_shards(docs: DataFrame, max_bytes: int, path: str, key: str = "doc_id") -> DataFrame:
    """Write the rows of ``docs`` below ``path`` in a folder for each shard; returns the directory.

    Every row is written once, into the shard that it was assigned to: rows travel through the assignment as one struct, so null and
    repeated keys need no join on the key. The columns of ``docs`` keep their names; the folders are named after ``shard``, with
    underscores added where ``docs`` has such a column.
    """
    folder = "shard"
    while folder.lower() in {c.lower() for c in docs.columns}:
        folder += "_"
    read = docs.select(F.col(key).alias("key"), _size().alias("n_bytes"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    shards = stash(_assign(read, max_bytes, "key", "n_bytes").select("row", *SHARD), "shards")
    out = shards.select("row.*", F.col("shard").alias(folder))
    out.repartition(folder).write.partitionBy(folder).mode("overwrite").parquet(path)
    return directory(shards)


def shard_sql(max_bytes: int, bits: int = 24) -> str:
    """The DuckDB twin over ``documents`` with unique ids: the shortest of all prefixes up to ``bits`` that fits."""
    nibble = "CASE substr(h, {i}, 1) " + " ".join(f"WHEN '{v:x}' THEN '{v:04b}'" for v in range(16)) + " END"
    return f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
b AS (SELECT doc_id, n_bytes, {' || '.join(nibble.format(i=i + 1) for i in range(bits // 4))} AS bits FROM h),
x AS (SELECT doc_id, n_bytes, substr(bits, 1, d) AS shard, d FROM b, range({bits + 1}) t(d)),
s AS (SELECT shard, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM x GROUP BY shard HAVING sum(n_bytes) <= {max_bytes} OR count(*) = 1),
r AS (SELECT x.doc_id, x.n_bytes, x.shard, x.d, s.shard_bytes, s.shard_rows, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.d) AS k FROM x JOIN s USING (shard))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, shard, CAST(d AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_rows AS BIGINT) AS shard_rows
FROM r WHERE k = 1"""
