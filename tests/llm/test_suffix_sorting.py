"""Two-stage sorting of suffixes, and repeats in crowded groups."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wardbook.llm import repeats


@pytest.mark.parametrize("letters", [b"a", b"ab", b"\x00a", bytes(range(256)), b"aaab"])
def test_order_equals_sorted_prefixes(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        raw = bytes(rng.choices(letters, k=rng.randint(0, 300)))
        data = np.frombuffer(raw, np.uint8)
        starts = np.zeros(len(raw), bool)
        starts[: max(0, len(raw) - 40 + 1)] = True
        order = repeats.two_stage_order(data, starts, 40)
        prefixes = [raw[i : i + 40] for i in order]
        assert sorted(order) == list(np.flatnonzero(starts)) and prefixes == sorted(prefixes)
        assert repeats.same_prefix(data, order, 40).tolist() == [a == b for a, b in zip(prefixes, prefixes[1:])]


def expected(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + length] for t in data for k in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((len(t), sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4_096, 3])
def test_crowded_groups_are_split_without_loss(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 5)
    rng = random.Random(group)
    passage = "".join(rng.choices("abcd ", k=260))
    word = lambda n: "".join(rng.choices("efgh ", k=n))
    texts = [word(rng.randint(0, 90)) + passage[rng.randint(0, 70) : 260 - rng.randint(0, 60)] + word(rng.randint(0, 90)) for _ in range(25)]
    texts += [passage * 3, passage[:199], passage[:200], "é" * 400, "ab" * 500, None, "", word(5_000), texts[0], texts[0]]
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts)] + [(None, texts[1], 1, "x", 2)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key int, doc string, p int").repartition(3)
    want = expected([r[1] for r in rows], 200)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeats.cut_repeats(df).collect()]
    assert Counter(got) == Counter((r[0], *w) for r, w in zip(rows, want))
    assert any(w[1] for w in want) and any(w[0] > 200 and not w[1] for w in want)
