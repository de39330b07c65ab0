"""Classes that share signatures and are still apart meet once in tiles, whatever number of signatures they share."""

from __future__ import annotations

import random

import numpy as np
import pytest

from wardbook.llm import jaccard
from wardbook.llm.jaccard import allowed_difference, folded, near_pairs, pairs_within, parity_sketch

PERCENT = 80


def family(rng, base, size, changes):
    sets = []
    for _ in range(size):
        one = base.copy()
        at = rng.integers(0, len(base), rng.integers(0, changes))
        one[at] = rng.integers(0, 2**48, len(at), dtype=np.uint64)
        sets.append(np.unique(one[: len(one) - rng.integers(0, len(base) // 4)]))
    return sets


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_near_pairs_are_those_of_a_self_join(spark, monkeypatch, kind):
    rng, draw = np.random.default_rng(3), random.Random(3)
    sets = [s for n in (60, 260, 1_200) for s in family(rng, rng.integers(0, 2**48, n, dtype=np.uint64), 14, n // 8)]
    key = (lambda i: f"k{i:03d}") if kind == "string" else int
    classes = spark.createDataFrame([(key(i), len(s), parity_sketch(s, PERCENT).tolist()) for i, s in enumerate(sets)], f"id {kind}, n bigint, sketch array<bigint>")
    groups = [sorted(draw.sample(range(k, k + 14), draw.randint(2, 14))) for k in (0, 14, 28) for _ in range(30)]  # families share many signatures
    groups += [sorted({14, draw.choice(range(15, 42))}) for _ in range(40)]  # and one class shares signatures with many others, one by one
    component = {i: i - i % 3 for i in range(42)}
    placed = spark.createDataFrame([(s, key(d), key(component[d]), key(g[0]), len(g)) for s, g in enumerate(groups) for d in g], f"sig bigint, d {kind}, c {kind}, hub {kind}, m bigint")
    classes.createOrReplaceTempView("near_classes")
    placed.createOrReplaceTempView("near_placed")
    side = lambda a: f"(SELECT sig, d AS {a}, c AS c{a}, n AS n{a}, sketch AS p{a} FROM near_placed JOIN near_classes ON id = d) {a}"
    plain = {tuple(r) for r in spark.sql(f"SELECT DISTINCT x, y FROM {side('x')} JOIN {side('y')} USING (sig) WHERE x < y AND cx != cy AND {jaccard.may_link(PERCENT)}").collect()}
    every = {(key(i), key(j)) for i in range(42) for j in range(i) if component[i] != component[j]}
    every = {tuple(sorted(p)) for p in every}
    assert 5 < len(plain) < 300
    for tile_rows, at_once in ((512, 1_000_000), (3, 7)):
        monkeypatch.setattr(jaccard, "TILE_ROWS", tile_rows)
        monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", at_once)
        found = [tuple(r) for r in near_pairs(placed, classes, PERCENT).collect()]
        assert len(found) == len(set(found)) and plain <= set(found) <= every
        linked = {(key(i), key(j)) for i in range(42) for j in range(i + 1, 42) if (key(i), key(j)) in set(found)}
        sketches = {key(i): parity_sketch(s, PERCENT).view(np.uint64)[None, :] for i, s in enumerate(sets)}
        size = {key(i): len(s) for i, s in enumerate(sets)}
        for x, y in linked:
            words = min(sketches[x].shape[1], sketches[y].shape[1])
            apart = int(np.bitwise_count(folded(sketches[x], words) ^ folded(sketches[y], words)).sum())
            assert 180 * apart <= 20 * (size[x] + size[y])


def test_a_pair_is_compared_once_and_not_per_signature(spark, monkeypatch):
    """Forty near copies that share three hundred signatures are one block of forty rows."""
    rng = np.random.default_rng(4)
    sets = family(rng, rng.integers(0, 2**48, 200, dtype=np.uint64), 40, 30)
    classes = spark.createDataFrame([(i, len(s), parity_sketch(s, PERCENT).tolist()) for i, s in enumerate(sets)], "id bigint, n bigint, sketch array<bigint>")
    placed = spark.range(300).selectExpr("id AS sig", "explode(sequence(0L, 39L)) AS d").selectExpr("sig", "d", "d AS c", "0L AS hub", "40L AS m")
    written, plain = {}, jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda df, name: written.setdefault(name, plain(df, name)))
    near_pairs(placed, classes, PERCENT).collect()
    assert written["hub-members"].count() == 40 and [r["whole"] for r in written["hubs"].collect()] == [True]


def test_tiles_pair_all_rows_of_a_block(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 4)
    tile = np.array([1, 1, 1, 2, 5, 5, 5, 5, 5, 9, 9])
    side = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1])
    found = [p for x, y in pairs_within(tile, side) for p in zip(x.tolist(), y.tolist())]
    assert sorted(found) == [(0, 1), (0, 2), (1, 2), (4, 6), (4, 7), (4, 8), (5, 6), (5, 7), (5, 8), (9, 10)]
    x = np.arange(400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert allowed_difference(400, PERCENT) == 100 and folded(parity_sketch(x, PERCENT).view(np.uint64)[None, :], 1).shape == (1, 1)
