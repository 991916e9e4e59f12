"""Sinks and stores: featured parquet (SRC6/SRC7), JSON metrics (SRC8/SRC9), models (SRC10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_featured(df: DataFrame, path: str, partition_col: str = "plant_id") -> None:
    """SRC6: featured table as parquet partitioned by plant, rows sorted by
    (inverter, time) inside files so inverter/time filters prune row groups.

    Rows are dealt by plant; adaptive execution splits plants that are too large for a task and joins small ones. Nothing is sampled, so
    what computes ``df`` runs once."""
    (df.hint("rebalance", partition_col)
       .sortWithinPartitions(partition_col, "inverter_id", "datetime")
       .write.mode("overwrite").partitionBy(partition_col).parquet(path))


def read_featured(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC7: scan of the stored featured table; ``columns`` is pushed into the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_json_table(df: DataFrame, path: str) -> None:
    """SRC8: small result tables (metrics, baselines) as JSON lines, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC9: JSON tables written by :func:`write_json_table` (or multi-line JSON documents)."""
    reader = spark.read.option("multiLine", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def save_model(model: PipelineModel, path: str) -> None:
    """SRC10: fitted pipeline (assembler keeps the feature-name list in order)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_feature_names(model: PipelineModel) -> list[str]:
    """The model's input feature names, from its VectorAssembler stage."""
    for st in model.stages:
        if hasattr(st, "getInputCols"):
            return list(st.getInputCols())
    return []
