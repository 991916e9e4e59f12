"""SRC1, SRC2, SRC5 as a Spark data source: ``spark.read.format("fleet_csv")`` over ``<root>/Plant */*.csv``.

The plan is one scan however many files and headers there are: a task takes a share of the files, reads each one's own header and gives out
Arrow batches, a row per reading and inverter block, with the block's fields as a map. ``option("headers", "true")`` gives each file's
header in place of its rows. Equality filters on ``plant_id`` leave out whole folders before anything is opened.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.numeric import to_double
from ..functions.timefns import parse_epoch_millis, parse_text_timestamp
from . import csv_telemetry
from .csv_telemetry import _INV, common_columns, detect_inverter_count, smu_columns

# readers travel by value: the workers that plan a scan have no access to files added to the session
for _module in (sys.modules[__name__], csv_telemetry):
    cloudpickle.register_pickle_by_value(_module)

ROWS = ("plant_id string, file string, logger_mac string, time_text string, time_millis string, inverter_idx int, "
        "fields map<string,string>, strings array<string>")
HEADERS = "plant_id string, file string, header array<string>"
#: Bytes and files that a task takes at most (a larger file is a task of its own, streamed).
TASK_BYTES, TASK_FILES = 64 << 20, 500


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str]]


class FleetCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fleet_csv"

    def schema(self) -> str:
        return HEADERS if self.options.get("headers") == "true" else ROWS

    def reader(self, schema) -> DataSourceReader:
        return FleetCsvReader(self.options["path"], self.options.get("headers") == "true")


class FleetCsvReader(DataSourceReader):
    def __init__(self, root: str, headers: bool):
        self.root, self.headers, self.plants = root, headers, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is None or f.attribute != ("plant_id",):
                yield f
            else:
                self.plants = asked if self.plants is None else self.plants & asked

    def partitions(self) -> Sequence[Files]:
        """Shares of the files, by plant and name. Listing opens no file."""
        fs, base = pafs.FileSystem.from_uri(self.root)
        found = []
        for d in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda d: d.base_name):
            plant = d.base_name.replace(" ", "_")
            if d.type != pafs.FileType.Directory or not d.base_name.startswith("Plant ") or (self.plants is not None and plant not in self.plants):
                continue
            found += [(plant, f.path, f.size) for f in sorted(fs.get_file_info(pafs.FileSelector(d.path)), key=lambda f: f.base_name)
                      if f.type == pafs.FileType.File and f.base_name.endswith(".csv") and f.size]
        out, share, size = [], [], 0
        for plant, path, n in found:
            if share and (size + n > TASK_BYTES or len(share) == TASK_FILES):
                out.append(Files(share))
                share, size = [], 0
            share.append((plant, path))
            size += n
        return [*out, Files(share)] if share else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        for plant, path in partition.files:
            yield from (self._header if self.headers else self._rows)(fs, plant, path)

    def _names(self, fs, path: str) -> list[str]:
        """The file's header; the first of equal names counts, as the others get a number."""
        with fs.open_input_stream(path) as raw:
            first = raw.read(1 << 20).decode("utf-8-sig", "replace").splitlines()
        names = [n.strip() for n in next(csv.reader(first[:1]), [])] if first else []
        return [n if n not in names[:i] else f"{n}#{i}" for i, n in enumerate(names)]

    def _header(self, fs, plant: str, path: str) -> Iterator[pa.RecordBatch]:
        names = self._names(fs, path)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([plant]), pa.array([path.rsplit("/", 1)[-1]]), pa.array([names], pa.list_(pa.string()))], names=["plant_id", "file", "header"])

    def _batches(self, fs, path: str, names: list[str], only: list[str] | None = None) -> Iterator[pa.RecordBatch]:
        """The file's rows, all columns as text, empty ones null; rows with another number of fields are left out."""
        text = {n: pa.string() for n in names}
        with fs.open_input_stream(path) as raw:
            reader = pacsv.open_csv(raw, pacsv.ReadOptions(column_names=names, skip_rows=1), pacsv.ParseOptions(invalid_row_handler=lambda r: "skip", newlines_in_values=False),
                                    pacsv.ConvertOptions(column_types=text, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True, include_columns=only))
            for b in reader:
                if b.num_rows:
                    yield b

    def _rows(self, fs, plant: str, path: str) -> Iterator[pa.RecordBatch]:
        names = self._names(fs, path)
        n_inv = detect_inverter_count(names)
        blocks = []
        for i in range(n_inv):
            own = [(c, _INV.sub("inv_", c)) for c in names if c.startswith(f"inverters[{i}].")]
            if own:
                blocks.append((i, common_columns(names) + own, smu_columns(names, i)))
        if not blocks:
            return
        name = path.rsplit("/", 1)[-1]
        known = (v for b in self._batches(fs, path, names, ["mac"]) for v in b.column("mac").drop_null().slice(0, 1).to_pylist()) if "mac" in names else iter(())
        logger = next(known, name.removesuffix(".csv"))
        for b in self._batches(fs, path, names):
            n = b.num_rows
            whole = lambda v, n=n: pa.array([v] * n, pa.string())
            column = lambda c, b=b, n=n: b.column(c) if c in names else pa.nulls(n, pa.string())
            for i, fields, strings in blocks:
                maps = pa.MapArray.from_arrays(_offsets(n, len(fields)), pa.array([t for _, t in fields] * n, pa.string()), _by_row([b.column(c) for c, _ in fields], n))
                lists = pa.ListArray.from_arrays(_offsets(n, len(strings)), _by_row([b.column(c) for c in strings], n))
                yield pa.RecordBatch.from_arrays([whole(plant), whole(name), whole(logger), column("timestampDate"), column("timestamp"),
                                                  pa.array([i] * n, pa.int32()), maps, lists],
                                                 names=["plant_id", "file", "logger_mac", "time_text", "time_millis", "inverter_idx", "fields", "strings"])


def _offsets(n: int, width: int) -> pa.Array:
    return pa.array(np.arange(n + 1, dtype=np.int32) * width)


def _by_row(columns: list[pa.Array], n: int) -> pa.Array:
    """The columns' values row by row."""
    if not columns:
        return pa.array([], pa.string())
    order = (np.arange(n)[:, None] + n * np.arange(len(columns))[None]).ravel()
    return pa.concat_arrays(columns).take(pa.array(order))


def _qualified(spark: SparkSession, root: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def scan(spark: SparkSession, root: str, headers: bool = False, plants: Sequence[str] | None = None) -> DataFrame:
    """The files' rows (``ROWS``) or headers (``HEADERS``), of some ``plants`` (ids) only if named."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FleetCsv)
    df = spark.read.format("fleet_csv").option("headers", str(headers).lower()).load(_qualified(spark, root))
    return df if plants is None else df.where(F.col("plant_id").isin(list(plants)))


def _string_stats(strings: Column, width: Column) -> list[Column]:
    """PRJ5 over an array of texts: mean, sample deviation, zeros and number of strings; null where the block has none."""
    known = F.filter(F.transform(strings, to_double), lambda v: v.isNotNull() & ~F.isnan(v))
    n = F.size(known).cast("double")
    mean = F.when(n > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / n)
    apart = F.aggregate(known, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    zeros = F.size(F.filter(known, lambda v: v == 0)).cast("double")
    none = F.lit(None).cast("double")
    some = width > 0
    return [F.when(some, mean).otherwise(none).alias("smu_string_mean"), F.when(some & (n > 1), F.sqrt(apart / (n - 1))).otherwise(none).alias("smu_string_std"),
            F.when(some, zeros).otherwise(none).alias("smu_num_zero"), F.when(some, width.cast("double")).otherwise(none).alias("smu_total_strings")]


def load_readings(spark: SparkSession, root: str, plants: Sequence[str] | None = None, carry_file: bool = False) -> DataFrame:
    """All plants' files as raw per-inverter readings: what ``csv_telemetry.load_all_plants(hourly=False)`` gives, from one scan.

    Columns are those of the distinct headers, which the driver gets (not the files'). A logger is named by the first ``mac`` in its file, by the
    file's name where there is none. Raises where no file has an inverter block.
    """
    found = [r.header for r in scan(spark, root, True, plants).select("header").distinct().collect()]
    usable = [h for h in found if detect_inverter_count(h)]
    if not usable:
        raise ValueError("No data loaded!")
    usable.sort()
    common = list(dict.fromkeys(t for h in usable for _, t in common_columns(h)))
    own = list(dict.fromkeys(_INV.sub("inv_", c) for h in usable for c in h if _INV.match(c)))
    with_smu = any(smu_columns(h, i) for h in usable for i in range(detect_inverter_count(h)))
    time = F.coalesce(parse_text_timestamp(F.col("time_text")), F.when(F.col("time_text").isNull(), parse_epoch_millis(F.col("time_millis"))))
    rows = scan(spark, root, False, plants).withColumn("datetime", time).where(F.col("datetime").isNotNull())
    out = rows.select(*([F.col("file").alias("_file")] if carry_file else []), "datetime", *(to_double(F.col("fields")[t]).alias(t) for t in common), "plant_id", "logger_mac",
                      *(to_double(F.col("fields")[t]).alias(t) for t in own),
                      *(_string_stats(F.col("strings"), F.size("strings")) if with_smu else []), "inverter_idx")
    return out.withColumn("inverter_id", F.concat("plant_id", F.lit("_"), "logger_mac", F.lit("_INV"), F.col("inverter_idx").cast("string")))
