"""A corpus pipeline of five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from porelith.llm import bagminhash, mixing, pieces, quality_rules, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality_rules", quality_rules.stage),
    ("near_duplicates", bagminhash.stage),
    ("mixing", mixing.stage),
    ("pieces", pieces.stage),
]

#: SQL expresses neither the learned lexicon nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
