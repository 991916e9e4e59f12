"""SRC10: fitted models kept below ``spark.checkpoint.dir`` by a fingerprint of their data, settings and code.

A model is trained when it is first asked for and loaded afterwards, also by other applications that share the folder. What is
written last (the model's ``meta``) makes it complete, so a job that dies while training leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from ..session import scratch_path
from . import boost, iforest

#: Modules whose code decides what a stored model is.
_MODULES = ["models/boost.py", "models/iforest.py", "operators/folds.py", "operators/matrix.py", "operators/metrics.py", "operators/ranking.py"]


def code_fingerprint() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for rel in _MODULES:
        try:
            with open(os.path.join(root, rel), "rb") as fh:
                h.update(fh.read())
        except OSError:  # shipped as a zip
            h.update(rel.encode())
    return h.hexdigest()[:12]


CODE = code_fingerprint()


def model_path(spark: SparkSession, kind: str, data: str, settings: dict) -> str:
    """Where the model of ``kind`` on the data named ``data`` (a fingerprint) with ``settings`` lies."""
    key = hashlib.sha1(json.dumps([kind, data, settings, CODE], sort_keys=True, default=str).encode()).hexdigest()[:16]
    return scratch_path(spark, f"models/{kind}-{key}")


def is_complete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def stored(spark: SparkSession, path: str, train: Callable[[], Any], save: Callable[[Any, str], None], load: Callable[[str], Any]) -> Any:
    """The model at ``path``, trained and saved there if it isn't complete. What is returned was always read back."""
    if not is_complete(spark, path):
        save(train(), path)
    return load(path)


def boosted(spark: SparkSession, path: str, train: Callable[[], boost.Boosted]) -> boost.Boosted:
    return stored(spark, path, train, lambda m, p: boost.save(m, spark, p), lambda p: boost.load(spark, p))


def forest(spark: SparkSession, path: str, train: Callable[[], iforest.Forest]) -> iforest.Forest:
    return stored(spark, path, train, iforest.save_forest, lambda p: iforest.load_forest(spark, p))
