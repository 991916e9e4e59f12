"""The corpus pipeline: ``STAGES`` over ``documents``, each stage written and read again.

A stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetrisk.llm import decontam, packing, secrets, simhash, toxicity
from fleetrisk.llm.common import prepare, stash, table
from fleetrisk.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    prepare(spark)
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    prepare(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    prepare(spark)
    return packing.with_crc(packing.pack(docs, tokenizer_file()))


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", drop_leaks), ("secrets", redact_secrets), ("packing", pack)]

#: Scoring, hashing and tokenising stages have no SQL form; tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
