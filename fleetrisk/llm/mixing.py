"""Mixing sources to target weights (operator 12), in DataFrame functions: hash-threshold histograms.

Every row has a place on a line of 120 hash bits. A source takes all rows a whole number of times and once more those that lie before its
threshold. Thresholds are found by histograms of words by source and hash bucket; each round splits only the bucket
that holds a source's threshold, so no rows are sorted. The row on the threshold gives the words that are still missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash

#: Hash bits that a round looks at, and bits of each of the two keys.
STEP, BITS = 12, 60
#: Sources, and bytes of their names, up to which their table is broadcast; beyond, the join is salted.
MOST_SOURCES, MOST_BYTES = 100_000, 16_000_000
SALTS = 256
_WORDS = r"[^\x20\x09-\x0D]+"


def _sources(rows: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(src, size, weight): weights repeat along the sources by code point, null last. Sources are numbered over ranges."""
    sums = rows.groupBy("src").agg(F.sum("size").alias("source_size")).repartitionByRange("src").withColumn("_part", F.spark_partition_id())
    sums = stash(sums, "mix-sources")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = sums.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("src")) - 1
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (F.pmod(at, F.lit(len(weights))) + 1).cast("int"))
    return sums.join(F.broadcast(parts), "_part").select("src", "source_size", weight.alias("weight"))


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: ``share`` of all sizes by weight, none above ``most`` times its size.

    What is cut off is shared again by weight among the others until none is above. A round is one aggregate; only the level (words
    a unit of weight) comes to the driver. If all are cut, targets sum to less than the share.
    """
    cap = F.col("source_size") * most
    free = {}
    while True:
        # sources above the level of the round before are cut
        cut = F.lit(False) if not free else (F.col("weight") * free["num"] >= cap * free["den"])
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(cut, cap)).alias("cut"), F.sum(F.when(~cut, F.col("weight"))).alias("w"),
                        F.count_if(cut).alias("n")).first()
        if not r["w"]:
            return sources.withColumn("target", cap.cast("double"))
        if free and r["n"] == free["n"]:
            break
        free = {"num": F.lit(share * r["all"] - (r["cut"] or 0)), "den": F.lit(float(r["w"])), "n": r["n"]}
    return sources.withColumn("target", F.when(cut, cap.cast("double")).otherwise(F.col("weight") * free["num"] / free["den"]))


def _with_source(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """``rows`` joined to a table with a row a source: broadcast when few, else by source and a salt, so a hot source is spread."""
    if small:
        return rows.join(F.broadcast(table), "src")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod("k2", F.lit(SALTS)).cast("int")).join(salted, ["src", "_salt"]).drop("_salt")


def _bucket(level: int) -> Column:
    """The level's bits of a row's place."""
    per = BITS // STEP
    key, shift = ("k1", "k2")[level // per], BITS - STEP * (level % per + 1)
    return F.shiftright(key, shift).bitwiseAND(F.lit((1 << STEP) - 1).cast("long"))


def _prefix(level: int) -> tuple[Column, Column]:
    """The bits of a row's place before the level, as two numbers."""
    per, done = BITS // STEP, STEP * (level % (BITS // STEP))
    first = F.shiftright("k1", BITS - done) if level < per else F.col("k1")
    second = F.shiftright("k2", BITS - done) if level >= per else F.lit(0).cast("long")
    return first, second


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, weight, target, copies, taken.

    ``size`` is the number of words (runs of anything but space and tab to carriage return) of the text, 0 for a null or empty one.
    Sources by code point, null last as a source of its own, weigh ``weights`` in turn; see ``targets``. ``taken`` words are ``copies`` whole
    copies and, if it is more than these hold, that many words more from the text's start: at most one row of a source is taken in part,
    the one on its threshold. A source's taken words sum to its target, rounded; none is above ``most`` sizes.

    A row's place is its md5 over doc_id and text, so reruns agree. Rows that repeat an id and a text share the first 60 bits and are told
    apart by a written row number: which of them is taken is arbitrary, but not how many. Null ids count as empty ones; an empty
    table gives an empty one; other columns are not read.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat(said("doc_id"), F.lit(":"), said("text"))), 1, BITS // 4), 16, 10).cast("long")
    src = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), said("source"))  # null last
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), src.alias("src"),
                             F.regexp_count(said("text"), F.lit(_WORDS)).cast("long").alias("size"), key.alias("k1"),
                             F.monotonically_increasing_id().alias("row")), "mix-rows")
    rows = rows.withColumn("k2", F.shiftrightunsigned(F.xxhash64("row"), 64 - BITS))
    sources = targets(_sources(rows, weights), share, most)
    words = F.floor(F.col("target") + 0.5).cast("long")
    copies = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    copies = F.when(copies * F.col("source_size") > words, copies - 1).otherwise(copies)
    state = sources.withColumn("copies", copies).withColumn("need", words - F.col("copies") * F.col("source_size"))
    # the threshold so far: prefix bits (p1, p2) of ``level`` rounds; a source is open while more than one row with words lies there
    state = stash(state.select("*", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(0).alias("level"), (F.col("need") > 0).alias("open")), "mix-state")
    n, size = state.agg(F.count(F.lit(1)), F.sum(F.octet_length("src"))).first()
    small = n <= MOST_SOURCES and (size or 0) <= MOST_BYTES
    for level in range(2 * BITS // STEP):
        if not state.where("open").limit(1).count():
            break
        first, second = _prefix(level)
        asked = state.where("open").select("src", "p1", "p2", "need")
        inside = _with_source(rows.where("size > 0"), asked, small).where((first == F.col("p1")) & (second == F.col("p2")))
        hist = inside.groupBy("src", _bucket(level).alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("need").alias("left"))
        upto = F.sum("words").over(Window.partitionBy("src").orderBy("b"))  # at most 4096 buckets a source
        met = (hist.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
               .select("src", "b", "n", (F.col("left") - F.col("upto") + F.col("words")).alias("left")))
        hit = F.col("b").isNotNull()
        down = lambda p: F.shiftleft(p, STEP) + F.col("b")
        own = level < BITS // STEP
        nxt = stash(state.join(met, "src", "left").select(
            "src", "source_size", "weight", "target", "copies", F.when(hit, F.col("left")).otherwise(F.col("need")).alias("need"),
            (F.when(hit, down("p1")).otherwise(F.col("p1")) if own else F.col("p1")).alias("p1"),
            (F.col("p2") if own else F.when(hit, down("p2")).otherwise(F.col("p2"))).alias("p2"),
            F.when(hit, F.lit(level + 1)).otherwise(F.col("level")).alias("level"),
            F.when(hit, (F.col("left") > 0) & (F.col("n") > 1)).otherwise(F.lit(False)).alias("open")), "mix-state")
        discard(state)
        state = nxt
    placed = _with_source(rows, state, small)
    # a row before the threshold's bucket is taken once more, the row in it gives what is missing
    per = BITS // STEP
    a = F.expr(f"shiftright(k1, greatest({BITS} - {STEP} * level, 0))")
    b = F.expr(f"CASE WHEN level <= {per} THEN 0L ELSE shiftright(k2, {2 * BITS} - {STEP} * level) END")
    before = (a < F.col("p1")) | ((a == F.col("p1")) & (b < F.col("p2")))
    here = (a == F.col("p1")) & (b == F.col("p2"))
    extra = F.when(F.col("level") == 0, F.lit(0)).when(before, F.col("size")).when(here, F.least("need", "size")).otherwise(F.lit(0))
    return placed.select("doc_id", "source", "size", "source_size", "weight", "target",
                         (F.col("copies") + F.when((F.col("level") > 0) & (F.col("size") > 0) & (extra == F.col("size")), F.lit(1)).otherwise(F.lit(0))).alias("copies"),
                         (F.col("copies") * F.col("size") + extra).cast("long").alias("taken"))


def mix_sql(weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> str:
    """The DuckDB twin of the query: sorted, by windows; targets in closed form (levels of sources by size over weight)."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(
        len(weights), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST({weight} AS DOUBLE) AS w, sum(n) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum({most} * n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
             sum(w) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT cut, free FROM o WHERE ({share} * total - cut) / free <= {most} * n / w ORDER BY n / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, n, CASE WHEN (SELECT free FROM l) IS NULL OR w * ({share} * total - (SELECT cut FROM l)) >= {most} * n * (SELECT free FROM l) THEN {most} * n
             ELSE w * ({share} * total - (SELECT cut FROM l)) / (SELECT free FROM l) END AS target FROM o),
p AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, CASE WHEN n > 0 THEN CAST(floor(floor(target + 0.5) / n) AS BIGINT) ELSE 0 END AS copies FROM t),
r AS (SELECT d.*, p.n, p.target, p.copies, p.words - p.copies * CAST(p.n AS BIGINT) AS need,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(k, 1, 15), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(copies * size + greatest(0, least(size, need - ahead)) AS BIGINT) AS taken FROM r"""
