"""The stored featured table: built once per source snapshot, read by every report.

Pipeline A writes its result as parquet (SRC6) into the shared folder named by
``spark.checkpoint.dir``; dashboards, metrics, training and scoring read it
back (SRC7) with column pruning. The store key is the source table's path,
size and modification time plus the label horizon, so a changed source builds
a new table. Reading a written table also cuts lineage: downstream plans start
at a parquet scan instead of re-planning the whole feature job.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.sinks import read_featured, write_featured
from ..sources.tables import table_path
from .featurize import featured_from_events

STORE_VERSION = "2"

# Modules whose code defines the stored table; their text is part of the key,
# so a changed feature pipeline never reads a table written by an older one.
_PIPELINE_MODULES = ["plans/featurize.py", "operators/features.py", "operators/chunking.py",
                     "operators/hourly.py", "operators/matrix.py", "operators/stats.py",
                     "sources/events_fixture.py", "sources/sinks.py", "functions/kpi.py",
                     "functions/numeric.py", "functions/timefns.py", "schema.py"]


def _code_fingerprint() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for rel in _PIPELINE_MODULES:
        try:
            with open(os.path.join(root, rel), "rb") as fh:
                h.update(fh.read())
        except OSError:
            h.update(rel.encode())
    return h.hexdigest()[:12]


CODE_FINGERPRINT = _code_fingerprint()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _source_key(spark: SparkSession, sf_dir: str, window_days: int) -> str:
    """Names the snapshot: path, size and time of every file below the source, and the code."""
    fs, p = _fs(spark, table_path(sf_dir, "events"))
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        st = files.next()
        found.append(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}")
    ident = hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()
    return hashlib.sha1(f"{STORE_VERSION}|{CODE_FINGERPRINT}|{ident}|{window_days}".encode()).hexdigest()[:16]


def _complete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(p))


def featured_store_path(spark: SparkSession, sf_dir: str, window_days: int = 7) -> str:
    return scratch_path(spark, f"featured/{_source_key(spark, sf_dir, window_days)}")


def featured_table(spark: SparkSession, sf_dir: str, window_days: int = 7, columns=None) -> DataFrame:
    """Stored featured table for ``sf_dir`` (built and written on first use)."""
    path = featured_store_path(spark, sf_dir, window_days)
    if not _complete(spark, path):
        write_featured(featured_from_events(spark, sf_dir, window_days), path)
    return read_featured(spark, path, columns)


def baseline_table(spark: SparkSession, sf_dir: str, window_days: int = 7) -> DataFrame:
    """Healthy baseline (feature, median) stored as JSON next to its featured table.

    Built on first use with the exact distributed median (AG6, SRC8), then read
    back (SRC9) by serving, attribution and the feature catalogue.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    from ..operators.matrix import healthy_baseline
    from ..sources.sinks import read_json_table, write_json_table
    path = featured_store_path(spark, sf_dir, window_days) + "-baseline"
    if not _complete(spark, path):
        write_json_table(healthy_baseline(featured_table(spark, sf_dir, window_days), digits=None), path)
    schema = StructType([StructField("feature", StringType()), StructField("median", DoubleType())])
    return read_json_table(spark, path, schema)
