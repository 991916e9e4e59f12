"""Stored tables and artefacts (SRC6-SRC10)."""

import tempfile

from pyspark.ml.classification import LogisticRegression
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from fleetrisk.plans.store import baseline_table, featured_store_path, featured_table
from fleetrisk.sources.sinks import (load_model, model_feature_names, read_json_table, save_model,
                                     write_json_table)

SF = "/root/testdata/sf0.001"


def test_featured_store_roundtrip(spark):
    f = featured_table(spark, SF)
    assert f.count() == 951
    path = featured_store_path(spark, SF)
    assert spark.read.parquet(path).select("plant_id").distinct().count() == 3  # partitioned by plant
    pruned = featured_table(spark, SF, columns=["inverter_id", "target_binary"])
    assert pruned.columns == ["inverter_id", "target_binary"]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<inverter_id:string,target_binary:int>" in plan


def test_baseline_json(spark):
    b = baseline_table(spark, SF)
    rows = {r.feature: r.median for r in b.collect()}
    assert rows["hours_since_last_alarm"] == 9999.0 and len(rows) == 24
    out = tempfile.mkdtemp(prefix="fleetrisk-json-") + "/m"
    write_json_table(b, out)
    assert read_json_table(spark, out).count() == 24


def test_model_save_load(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0), (1.0, 0.0, 1.0), (0.5, 0.5, 1.0), (0.1, 0.9, 0.0)], "a double, b double, label double")
    m = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                         LogisticRegression(maxIter=5)]).fit(df)
    path = tempfile.mkdtemp(prefix="fleetrisk-model-") + "/m"
    save_model(m, path)
    again = load_model(path)
    assert model_feature_names(again) == ["a", "b"]
    assert again.transform(df).count() == 4
