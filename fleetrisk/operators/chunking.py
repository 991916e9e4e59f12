"""Row positions and halo chunks for per-entity row windows (WN8, scale path).

A window partitioned by ``inverter_id`` puts an inverter's whole history into
one task. To bound task size when one inverter holds a large share of the
rows, each entity's ordered rows are cut into chunks of ``chunk_rows``
positions. A chunk is shipped together with the ``back`` rows before it and
the ``ahead`` rows after it (halo copies), so every trailing frame of up to
``back + 1`` rows and every forward frame of up to ``ahead + 1`` rows is exact
for the chunk's own (core) rows. Unbounded "last event before" carries come
from a per-chunk summary table (one row per chunk).

Positions need no window over an entity's full history either: rows are
counted per (entity, day), the day counts are prefix-summed per entity (one
row per entity-day), and a row's position is that offset plus its rank inside
its own (entity, day) group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import OrderSpec

POS = "_pos"
CHUNK = "_chunk"
WCHUNK = "_wchunk"
CORE = "_core"


def add_positions(df: DataFrame, key: str = "inverter_id", order: str = "datetime",
                  tiebreak: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Add ``_pos``: 0-based rank of a row in its entity's ``order`` sequence."""
    b = bucket if bucket is not None else F.date_trunc("day", F.col(order))
    keyed = df.withColumn("_bucket", b)
    counts = keyed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(key, "_bucket").orderBy(order, *tiebreak)
    return (keyed.join(offsets, [key, "_bucket"])
            .withColumn(POS, (F.col("_off") + F.row_number().over(inner) - 1).cast("long"))
            .drop("_bucket", "_off"))


def chunk_of(chunk_rows: int) -> Column:
    return F.floor(F.col(POS) / chunk_rows).cast("long")


def explode_halo(df: DataFrame, chunk_rows: int, back: int, ahead: int) -> DataFrame:
    """Copy each row into its own chunk (core) and into neighbours needing it as halo."""
    if chunk_rows < max(back, ahead, 1):
        raise ValueError("chunk_rows must be at least the halo width")
    chunk = chunk_of(chunk_rows)
    offset = F.col(POS) - chunk * chunk_rows
    targets = F.array_compact(F.array(
        chunk,
        F.when(offset >= chunk_rows - back, chunk + 1),
        F.when((offset < ahead) & (chunk > 0), chunk - 1),
    ))
    return (df.withColumn(CHUNK, chunk)
            .withColumn(WCHUNK, F.explode(targets))
            .withColumn(CORE, F.col(WCHUNK) == F.col(CHUNK)))


def chunk_spec(key: str = "inverter_id") -> OrderSpec:
    return OrderSpec(partition=(key, WCHUNK), order=(POS,))


def carry_last_before(df: DataFrame, chunk_rows: int, key: str, value: Column, name: str) -> DataFrame:
    """Per chunk: max of ``value`` over all earlier chunks of the entity.

    ``df`` carries ``_pos`` (not exploded). Output: key, ``_wchunk``, ``name``;
    one row per chunk, so the prefix window runs over chunk summaries only.
    """
    per_chunk = (df.groupBy(key, chunk_of(chunk_rows).alias(CHUNK))
                 .agg(F.max(value).alias("_m")))
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(key, F.col(CHUNK).alias(WCHUNK), F.max("_m").over(before).alias(name))
