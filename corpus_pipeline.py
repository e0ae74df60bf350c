"""Corpus pipeline: toxicity, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, exact_dedup, near_dup, packing, toxicity
from quarry.llm.queries import vocabulary
from quarry.llm.skew import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those the severity model rejects; it is fitted on the labels of ``docs``."""
    model = toxicity.fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: 5-word shingles, similarity 0.8."""
    return near_dup.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary(), capacity=4096, end_id=2)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies),
          ("decontamination", drop_benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


# Training, tokenizing and linear programming are not SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None
