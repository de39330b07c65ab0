"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.decontaminate import decontaminate
from wardbook.llm.embeddings import embedding_links
from wardbook.llm.html_text import extract_text
from wardbook.llm.jaccard import jaccard_groups
from wardbook.llm.packing import pack_documents
from wardbook.llm.pii import find_pii, fit_pii
from wardbook.llm.quality import fit_quality
from wardbook.llm.repeats import cut_repeats
from wardbook.llm.sharding import shard_documents
from wardbook.llm.token_count import count_tokens
from wardbook.llm.toxicity import score_toxicity
from wardbook.llm.vector_codes import compress_vectors
from wardbook.llm.whitening import whiten

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE_SQL: dict[str, str] = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), "contaminated")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LLM_ORACLE_SQL["op2_decontamination"] = f"""
WITH item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '{WORD}') AS w FROM benchmark
), win AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
    FROM item, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0
), doc AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents
), cand AS (
    SELECT doc_id, s.n, i, array_to_string(w[i : i + s.n - 1], ' ') AS gram
    FROM doc, (SELECT DISTINCT n FROM win) s, LATERAL (SELECT unnest(range(1, len(w) - s.n + 2)) AS i) WHERE len(w) >= s.n
), hit AS (
    SELECT doc_id, item, n, i FROM cand JOIN win USING (n, gram)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


@query
def op5_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where("quality = 1"), bad_keys=labels.where("quality = 0"))
    return model.judge(docs.select("doc_id", "text", "lang")).drop("text")


def _joined(spans: str):
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_pii(docs)).drop("text")
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@query
def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(books.sha256))


def _codes_sql(rounds: int = 4) -> str:
    """Codes and codebooks by comparing every part with every entry."""
    near = """, near{i} AS MATERIALIZED (
    SELECT row, p, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT row, a.p, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part a JOIN book{i} b ON a.p = b.p
    ) GROUP BY row, p
)"""
    improved = """, mean{i} AS (
    SELECT p, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS c FROM (
        SELECT p, entry, pos, CAST(sum(v[pos]) AS BIGINT) AS s, count(*) AS n
        FROM near{i} JOIN part USING (row, p), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS pos) GROUP BY p, entry, pos
    ) GROUP BY p, entry
), book{j} AS MATERIALIZED (
    SELECT p, entry, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, entry)
)"""
    steps = "".join(near.format(i=i) + improved.format(i=i, j=i + 1) for i in range(rounds)) + near.format(i=rounds)
    return f"""WITH sound AS (
    SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), kept AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS row FROM sound
), part AS MATERIALIZED (
    SELECT row, p, x[len(x) // 4 * p + 1 : len(x) // 4 * (p + 1)] AS v FROM kept, (SELECT unnest(range(4)) AS p)
), book0 AS MATERIALIZED (
    SELECT p, row AS entry, v AS c FROM part WHERE row < 256
){steps}, coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM near{rounds} JOIN kept USING (row) GROUP BY row, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) FROM book{rounds}) AS codebooks_sha256 FROM coded
"""


LLM_ORACLE_SQL["op11_vector_codes"] = _codes_sql()


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))[0]


LLM_QUERIES["pipeline"] = corpus_pipeline.run
