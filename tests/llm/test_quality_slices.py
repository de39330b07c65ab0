"""Operator 5 in slices, buckets and split buckets equals the same in one piece, and writes no trigram table."""

from __future__ import annotations

import random

import pytest

from wardbook.llm import quality


def test_slices_agree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(["the" if rng.random() < 0.3 else rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 300))]), "en") for i in range(60)]
    rows += [(60, "日本 x　カナ한글y", "en"), (61, " \n", "en"), (62, None, "en"), (63, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    new = spark.createDataFrame([(1, "the a the bb", "en"), *rows[:2]], docs.schema)
    written = []
    plain = quality.settle
    monkeypatch.setattr(quality, "settle", lambda df, name: written.append((name, plain(df, name))) or written[-1][1])

    def judged():
        model = quality.fit_quality(docs, docs.where("doc_id < 50").select("doc_id"))
        return [sorted(map(tuple, model.judge(d).collect()), key=str) for d in (docs, new)]

    whole = judged()
    assert not {name for name, _ in written} & {"trigrams", "gram-values"}
    for name, value in (("SLICES", 3), ("SLICE_WORDS", 100), ("BUCKET_WORDS", 150), ("CHUNK_CHARS", 2_000), ("HOT_WORDS", 2)):
        monkeypatch.setattr(quality, name, value)
    for one, other in zip(whole, judged()):
        assert len(one) == len(other)
        for a, b in zip(one, other):
            assert a[:3] == b[:3] and a[-1] == b[-1] and a[3:-1] == (pytest.approx(b[3:-1], rel=1e-9) if a[3] is not None else b[3:-1])
