"""SRC6/SRC7: a featured store that new readings update in place of a rebuild.

The store holds hourly rows, featured rows and row counts, each cut into chunks of time (``unit``) and written below a version. A manifest names
the version of every chunk. An update

1. aggregates the new readings and takes, per inverter, the rows that they can change: from 167 rows before the first new one (whose labels look ahead) on;
2. reads as many older rows as these rows' frames reach back (the counts say in which chunks they lie);
3. recomputes, and writes the chunks that hold a changed row under the next version; rows of other inverters in them are copied;
4. writes the next manifest, last. Readers see the old or the new store, never a mixture; a second writer of the same version fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timefns import hours_between
from ..operators.hourly import aggregate_hourly
from ..schema import NO_ALARM_HOURS
from ..session import materialize
from .featurize import TRAIL_ROWS, featurize

#: Layout of a chunk's name by unit of time.
UNITS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
TABLES = ("hourly", "featured", "counts")
KEYS = ["inverter_id", "datetime"]


@dataclass
class Manifest:
    """The state of a store: its settings and the version that each chunk was last written under."""
    version: int
    window_days: int
    unit: str
    chunks: dict[str, int]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, root: str) -> Manifest | None:
    """The store's latest manifest, None where there is no store."""
    fs, p = _fs(spark, f"{root}/manifests")
    if not fs.exists(p):
        return None
    last = max((f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("v")), default=None)
    if last is None:
        return None
    return Manifest(**json.loads("\n".join(r.value for r in spark.read.text(f"{root}/manifests/{last}").collect())))


def _commit(spark: SparkSession, root: str, m: Manifest) -> None:
    """The manifest appears whole, by a rename, and only where its version is new."""
    fs, folder = _fs(spark, f"{root}/manifests")
    jvm = spark.sparkContext._jvm
    fs.mkdirs(folder)
    temp, final = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f"_{uuid.uuid4().hex}", f"v{m.version:08d}.json"))
    out = fs.create(temp)
    out.write(json.dumps(m.__dict__).encode())
    out.close()
    if fs.exists(final) or not fs.rename(temp, final):
        raise RuntimeError(f"another writer has written version {m.version} of {root}")


def _chunk(unit: str) -> Column:
    return F.concat(F.lit("t"), F.date_format("datetime", UNITS[unit]))


def read(spark: SparkSession, root: str, table: str = "featured", chunks: list[str] | None = None) -> DataFrame | None:
    """The store's rows (of some ``chunks``) with their ``chunk``; None where no chunk is there. Filters on time should name chunks."""
    m = manifest(spark, root)
    names = sorted(m.chunks if chunks is None else set(chunks) & set(m.chunks)) if m else []
    if not names:
        return None
    paths = [f"{root}/{table}/v={m.chunks[c]:08d}/chunk={c}" for c in names]
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths).drop("v")


def _write(spark: SparkSession, root: str, version: int, hourly: DataFrame, featured: DataFrame) -> None:
    """The chunks of both tables and the counts, under ``version``; rows are dealt by chunk, large chunks are split."""
    counts = hourly.groupBy("chunk", "inverter_id").agg(F.count(F.lit(1)).alias("n"))
    for name, df in zip(TABLES, (hourly, featured, counts)):
        order = [c for c in ("chunk", "inverter_id", "datetime") if c in df.columns]
        (df.hint("rebalance", "chunk").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("chunk")
         .parquet(f"{root}/{name}/v={version:08d}"))


def create(spark: SparkSession, root: str, readings: DataFrame, window_days: int = 7, unit: str = "month") -> Manifest:
    """A store of all ``readings`` at ``root``, which must hold none yet."""
    if manifest(spark, root):
        raise ValueError(f"{root} holds a store; use update")
    hourly = materialize(aggregate_hourly(readings).withColumn("chunk", _chunk(unit)))
    featured = materialize(featurize(hourly.drop("chunk"), window_days).withColumn("chunk", _chunk(unit)))
    _write(spark, root, 1, hourly, featured)
    m = Manifest(1, window_days, unit, {r.chunk: 1 for r in hourly.select("chunk").distinct().collect()})
    _commit(spark, root, m)
    return m


def update(spark: SparkSession, root: str, readings: DataFrame) -> Manifest:
    """Take in new ``readings``; hours that are there already are replaced, so a file must hold whole hours of its inverters.

    Work follows the new rows, the frames around them, and the size of the chunks that hold a changed row. Readings in the middle of an
    inverter's history change all its later rows (hours since the last alarm) and cost as much. Without readings nothing is written.
    """
    m = manifest(spark, root)
    if m is None:
        raise ValueError(f"{root} holds no store; use create")
    new = materialize(aggregate_hourly(readings).withColumn("chunk", _chunk(m.unit)))
    first = materialize(new.groupBy("inverter_id").agg(F.min("datetime").alias("_t0"), F.min("chunk").alias("_c0")))
    if not first.limit(1).count():
        return m
    ahead = m.window_days * 24 - 1
    back = ahead + TRAIL_ROWS - 1  # rows before the first new one that are read
    # the chunks that hold these rows: those from the inverter's first new row on, and before it until the counts reach ``back``
    counts = read(spark, root, "counts").join(first, "inverter_id")
    older = counts.where(F.col("chunk") < F.col("_c0"))
    newer = Window.partitionBy("inverter_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    older = older.withColumn("_have", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("_have") < back).drop("_have")
    asked = materialize(counts.where(F.col("chunk") >= F.col("_c0")).unionByName(older).select("inverter_id", "chunk"))
    chunks = [r.chunk for r in asked.select("chunk").distinct().collect()]
    old = read(spark, root, "hourly", chunks) if chunks else None
    old = new.limit(0) if old is None else old.join(asked, ["inverter_id", "chunk"], "left_semi").select(*new.columns)
    old = old.join(new.select(*KEYS), KEYS, "left_anti").join(first.select("inverter_id", "_t0"), "inverter_id")
    # the last ``back`` rows before the first new one, all rows after it; each task keeps ``back`` rows an inverter before the shuffle
    place = F.row_number().over(Window.partitionBy("inverter_id").orderBy(F.desc("datetime")))
    before = old.where(F.col("datetime") < F.col("_t0")).withColumn("_rn", place).where(F.col("_rn") <= back)
    before = materialize(before)
    after = old.where(F.col("datetime") > F.col("_t0")).drop("_t0")
    rows = materialize(before.drop("_t0", "_rn").unionByName(after).unionByName(new))
    # rows from here on can change
    start = (before.where(F.col("_rn") <= ahead).groupBy("inverter_id").agg(F.min("datetime").alias("_r"))
             .join(first, "inverter_id", "right").select("inverter_id", F.coalesce("_r", "_t0").alias("_from")))
    start = materialize(start)
    made = featurize(rows.drop("chunk"), m.window_days)
    carry = _alarm_before(spark, root, before, chunks)
    if carry is not None and "hours_since_last_alarm" in made.columns:
        none = (F.col("hours_since_last_alarm") == NO_ALARM_HOURS) & F.col("_alarm").isNotNull()
        made = (made.join(carry, "inverter_id", "left")
                .withColumn("hours_since_last_alarm", F.when(none, hours_between(F.col("datetime"), F.col("_alarm"))).otherwise(F.col("hours_since_last_alarm"))).drop("_alarm"))
    made = made.join(start, "inverter_id").where(F.col("datetime") >= F.col("_from")).drop("_from")
    made = materialize(made.withColumn("chunk", _chunk(m.unit)))
    touched = [r.chunk for r in made.select("chunk").distinct().collect()]
    kept = read(spark, root, "featured", touched)
    featured = made
    if kept is not None:
        late = F.col("_from").isNotNull() & (F.col("datetime") >= F.col("_from"))
        featured = made.unionByName(kept.join(start, "inverter_id", "left").where(~late).select(*made.columns))
    hours = read(spark, root, "hourly", touched)
    hourly = new if hours is None else new.unionByName(hours.join(new.select(*KEYS), KEYS, "left_anti").select(*new.columns))
    # a touched chunk may hold no new hour: all its hours are copied with it
    nxt = Manifest(m.version + 1, m.window_days, m.unit, m.chunks | dict.fromkeys(touched, m.version + 1))
    _write(spark, root, nxt.version, hourly, featured)
    _commit(spark, root, nxt)
    return nxt


def _alarm_before(spark: SparkSession, root: str, before: DataFrame, chunks: list[str]) -> DataFrame | None:
    """(inverter_id, _alarm): the last alarm at or before each inverter's first row that is read, from that row's stored feature."""
    stored = read(spark, root, "featured", chunks) if chunks else None
    if stored is None or "hours_since_last_alarm" not in stored.columns:
        return None
    first = before.groupBy("inverter_id").agg(F.min("datetime").alias("datetime"))
    ago = F.round(F.col("hours_since_last_alarm") * 3_600_000_000).cast("long")
    alarm = F.timestamp_micros(F.unix_micros(F.col("datetime").cast("timestamp")) - ago).cast("timestamp_ntz")
    return (stored.join(first, KEYS, "left_semi").where(F.col("hours_since_last_alarm") < NO_ALARM_HOURS)
            .select("inverter_id", alarm.alias("_alarm")))
