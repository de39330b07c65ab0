"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.decontaminate import decontaminate
from wardbook.llm.jaccard import jaccard_groups
from wardbook.llm.packing import pack_documents
from wardbook.llm.pii import find_pii, fit_pii, redact
from wardbook.llm.quality import fit_quality
from wardbook.session import settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the perplexity bounds set on labelled text; those labelled 1 are the trusted ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = fit_quality(docs, labels.where("quality = 1"), bad_keys=labels.where("quality = 0")).judge(docs)
    return judged.where("kept").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 on five-word shingles, the one with the smallest id.

    Documents without an id stay. Of rows that repeat an id one stays.
    """
    groups = settle(jaccard_groups(docs.where("doc_id IS NOT NULL"), width=5, percent=80).select("doc_id", "component_id"), "groups")
    copies = groups.where("doc_id != component_id").select("doc_id").distinct()
    repeated = settle(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rest = docs.join(repeated, "doc_id", "left_anti")
    return rest.unionByName(once).join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; a document without an id stays only if no such one is hit."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = settle(found.where("contaminated").select(F.col("doc_id").alias("hit_id")).distinct(), "contaminated")
    return docs.join(hit, F.expr("doc_id <=> hit_id"), "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` as it is then."""
    clean = redact(find_pii(docs, fit_pii(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2,048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
