"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, mixing.

Every stage takes what the one before kept, written as Parquet and read again. The first
four return rows with the columns of ``documents``; the last returns one row a document with
the words that the mix takes from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontam, mixing, neardup, pii, toxicity
from fieldloom.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold; the labels are the given ones."""
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return neardup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and terms that give it away; no document goes."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken from each document for the target weights of its source."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]
#: SuperMinHash components and a trained classifier are not SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder of the session."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
