"""Operator 5 packs the n-grams of many chunks into one row for each bucket, with the same results however they are packed."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from wardbook.llm import quality


def test_chunks_are_packed_together(spark, monkeypatch):
    """Rows of the shuffle are buckets, not chunks times buckets, so they don't grow with the square of the corpus."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(200)) for _ in range(24)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    monkeypatch.setattr(quality, "CHUNK_CHARS", 500)
    chunks = list(quality.chunks(iter(docs.toArrow().to_batches()), False))
    made = [(np.arange(30) % 7, c.s[:30]) for c in chunks]
    assert len(chunks) >= 12
    rows = list(quality.packed(quality.TRUSTED, iter(made)))
    assert [r.num_rows for r in rows] == [7]
    assert sorted(quality.unpack(pa.Table.from_batches(rows), quality.TRUSTED, np.uint64)[0].tolist()) == sorted(np.concatenate([x for _, x in made]).tolist())
    monkeypatch.setattr(quality, "PACKED_GRAMS", 90)
    assert sum(r.num_rows for r in quality.packed(quality.TRUSTED, iter(made))) == -(-len(made) // 3) * 7
    assert quality.pack(quality.TRUSTED, np.zeros(0, np.int64), [np.zeros(0, np.uint64)]).num_rows == 0


def test_scores_do_not_depend_on_packs(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, " ".join("the" if rng.random() < 0.3 else rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 200)))) for i in range(30)]
    rows += [(30, "日本 x　カナ한글y " + "long" * 40), (31, " \n"), (32, None), (33, rows[0][1])]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string").coalesce(2)
    for name, value in (("SLICES", 2), ("SLICE_WORDS", 100), ("BUCKET_WORDS", 300), ("CHUNK_CHARS", 700), ("HOT_WORDS", 2)):
        monkeypatch.setattr(quality, name, value)

    def scores():
        return sorted(map(tuple, quality.fit_quality(docs, docs.where("doc_id < 25").select("doc_id")).known.collect()))

    whole = scores()
    monkeypatch.setattr(quality, "PACKED_GRAMS", 60)
    for one, other in zip(whole, scores(), strict=True):
        assert one[0] == other[0] and one[1:] == (pytest.approx(other[1:], rel=1e-9) if one[1] is not None else other[1:])


def test_characters_keep_their_numbers():
    """A table holds the numbers of usual characters at usual places; all others are made as before."""
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.integers(33, 1_000, 2_000), rng.integers(0, 0x110000, 500)]).astype(np.uint32)
    place = rng.integers(0, 200, len(points))
    assert np.array_equal(quality.character_ids(points, place), quality._mixed(points.astype(np.uint64), place.astype(np.uint64)))
