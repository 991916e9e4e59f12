"""Loads every query module so the catalog is complete, and exposes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis_queries, feature_queries, model_queries, report_queries  # noqa: F401  (register queries)
from .catalog import QUERIES, SQL
from .featurize import featured_from_events
from ..session import ensure_checkpoint_dir, ship_package


def _prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def _wrap(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _prepare(spark)
        return fn(spark, sf_dir)
    run.__doc__ = fn.__doc__
    return run


def all_queries():
    return {k: _wrap(v) for k, v in QUERIES.items()}


def all_sql():
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark)
    f = featured_from_events(spark, sf_dir)
    return (f.groupBy("target_multiclass")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("inverter_id").alias("n_inverters"),
                 F.sum("target_binary").cast("long").alias("n_at_risk"))
            .orderBy("target_multiclass"))
