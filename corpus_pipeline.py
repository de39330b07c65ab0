"""From raw documents to packed sequences: the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardbook.llm import stages
from wardbook.session import scratch_path

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("n-gram Jaccard join", stages.keep_one_of_near_copies),
    ("benchmark decontamination", stages.drop_contaminated),
    ("PII", stages.redact_personal_data),
    ("best-fit packing", stages.pack),
]

# Perplexities, boosted trees and packing have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
