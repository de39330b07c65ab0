"""The pipeline's stages and rows on the small tables, and the registered names."""

from __future__ import annotations

import corpus_pipeline
from wardbook.llm.queries import LLM_QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in LLM_QUERIES and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, left = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == names
            left.append(docs.count())
    assert left[0] > left[1] > left[2] >= left[3] == left[4]
    assert docs.select("doc_id").distinct().count() == left[4]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
