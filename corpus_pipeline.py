"""A corpus pipeline of five stages over `documents`: each writes Parquet that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ocrloom.llm.common import new_path, table
from ocrloom.llm.decontamination import drop_contaminated
from ocrloom.llm.mixing import mixed_documents
from ocrloom.llm.simhash import drop_near_copies
from ocrloom.llm.token_store import token_store
from ocrloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance predicts to be toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest doc_id."""
    return drop_near_copies(docs, radius=2, size=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them, the last one of a source perhaps in part."""
    return mixed_documents(docs, weights=(3, 1, 2), budget=1.5, most=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The content-addressed store of the mix, as its files verify: a row for each document."""
    return token_store(docs, "word_bpe_49k.json", end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: SQL has no zstandard, BK-tree, alignment or tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
