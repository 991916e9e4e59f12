"""Mergeable quantile sketches (AG6 at scale): one KLL sketch per day and feature, stored, merged without reading the rows again.

Karnin, Lang and Liberty, "Optimal quantile approximation in streams" (FOCS 2016). A merged sketch of size ``k`` answers a quantile within a
rank error that doesn't grow with the number of rows or of merges; see ``rank_error``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import unpivot

#: Size of the sketches.
K = 800


def rank_error(k: int = K) -> float:
    """The normalised rank error (two-sided, 99 %) of a sketch of size ``k``: 2.296 / k^0.9021, the library's published fit."""
    return 2.296 / k ** 0.9021


def day_sketches(df: DataFrame, features: Sequence[str], time: str = "datetime", k: int = K) -> DataFrame:
    """(day, feature, n, sketch): the features' values (null counts as 0, as in the exact baseline) of each day.

    One pass and one small shuffle: tasks sketch their own rows, sketches of a day are merged.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    days = df.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(value(c), k).alias(c) for c in features))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("sketch")) for c in features)))
    return days.select("day", "n", each.alias("s")).select("day", "s.feature", "n", "s.sketch")


def merged(sketches: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by..., n, sketch) over all days of ``sketches``."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketches: DataFrame, q: float = 0.5, name: str = "median") -> DataFrame:
    """``sketches`` with the ``q`` quantile in place of the sketch."""
    return sketches.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).drop("sketch")


def write_days(sketches: DataFrame, path: str) -> None:
    """Store sketches by day; the days that ``sketches`` holds are replaced, others stay."""
    (sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def stored_baseline(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(feature, n, median) over the stored days (of a range of dates): reads sketches only, of the days asked for."""
    days = spark.read.schema("feature string, n long, sketch binary, day date").parquet(path)
    if since:
        days = days.where(F.col("day") >= F.lit(since).cast("date"))
    if until:
        days = days.where(F.col("day") < F.lit(until).cast("date"))
    return quantile(merged(days))


def rank_check(df: DataFrame, medians: DataFrame, features: Sequence[str], q: float = 0.5, k: int = K) -> DataFrame:
    """(feature, n, within_bound): whether each sketched quantile's true rank among the rows of ``df`` is within twice the rank error."""
    found = {r.feature: r["median"] for r in medians.collect()}  # a row a feature
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    below = df.agg(F.count(F.lit(1)).alias("n"), *(F.struct(F.count_if(value(c) < found[c]).alias("lo"), F.count_if(value(c) <= found[c]).alias("hi")).alias(c) for c in features))
    slack = 2 * rank_error(k)
    ok = [((F.col(c)["lo"] <= (q + slack) * F.col("n")) & (F.col(c)["hi"] >= (q - slack) * F.col("n"))).cast("int").alias(c) for c in features]
    return unpivot(below.select("n", *ok), ["n"], list(features)).select("feature", "n", (F.col("value") == 1).alias("within_bound"))
