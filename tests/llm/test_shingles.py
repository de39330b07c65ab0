"""Shingles and signatures of many texts at once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from wardbook.llm import jaccard
from wardbook.llm.jaccard import ShingleHasher, allowed_difference, band_table, in_chunks, part_signatures, ragged, signatures, words_of


def sets_of(texts, width=4):
    x, bounds = ShingleHasher(width)([words_of(t) for t in texts])
    return [x[a:b] for a, b in zip(bounds[:-1], bounds[1:])], x, bounds


TEXTS = ["", None, "A", "a b", "a b c", "a b c d", "A\tB\x0bc  d E", "a b c d e", " \n", "\xa0 Ä b", "a\x1cb c d e f", "x y " * 40] + [" ".join(f"w{i}" for i in range(n)) for n in (6, 17, 90, 400)]


@pytest.mark.parametrize("width", [1, 4, 5])
def test_shingles_of_texts_together_are_those_of_each(width):
    together, x, bounds = sets_of(TEXTS, width)
    assert bounds[0] == 0 and bounds[-1] == len(x) and len(bounds) == len(TEXTS) + 1
    plain = []
    for t, found in zip(TEXTS, together):
        w = [v for v in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if v]
        plain.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
        assert len(found) == len(plain[-1]) and (np.diff(found.astype(np.int64)) > 0).all()
        assert found.tolist() == sets_of([t], width)[0][0].tolist()
    for a, x in zip(plain, together):
        for b, y in zip(plain, together):
            assert len(np.intersect1d(x, y)) == len(a & b)


def test_signatures_of_sets_together_are_those_of_each():
    together, x, bounds = sets_of(TEXTS)
    highs = band_table(85, 400)
    sig, owner = signatures(x, bounds, highs, 85)
    for i, one in enumerate(together):
        alone, of = signatures(one, np.array([0, len(one)]), highs, 85)
        assert (of == 0).all() and sorted(sig[owner == i].tolist()) == sorted(alone.tolist())
    assert signatures(np.empty(0, np.uint64), np.array([0, 0]), highs, 85)[0].size == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    highs, sets = band_table(85, 1_000), []
    for size in [*range(8, 60), 150, 400]:
        x = np.unique(rng.integers(0, 2**48, size, dtype=np.uint64))
        fewer = rng.permutation(x)[: -(-85 * len(x) // 100)]  # the smallest subset that is linked
        sets += [x, np.sort(fewer)]
    sig, owner = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), highs, 85)
    for i in range(0, len(sets), 2):
        assert np.intersect1d(sig[owner == i], sig[owner == i + 1]).size, len(sets[i])


def test_signatures_cover_two_of_three_parts():
    x, k = np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([allowed_difference(50, 85)] * 2)
    sig, bare, cells = part_signatures(np.concatenate([x, x[:1]]), np.array([50, 1]), np.array([3, 3]), k, 0)
    assert cells.tolist() == [(k[0] // 2 + 1) * 3] * 2 and len(sig) == len(bare) == cells.sum()
    # A single element lies in one cell, so all others of its partition leave their own out and cover it.
    assert (~bare[cells[0] :]).sum() == 2


def test_chunks_keep_rows_and_order(monkeypatch):
    monkeypatch.setattr(jaccard, "WORDS_AT_ONCE", 10)
    monkeypatch.setattr(jaccard, "TEXTS_AT_ONCE", 3)
    texts = ["a b c", None, "", "d " * 30, "e", "f g", "", "h"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"]), pa.RecordBatch.from_arrays([pa.array([9]), pa.array(["z"])], names=["key", "text"])]
    made = list(in_chunks(iter(batches)))
    assert [k for part, _ in made for k in part.column(0).to_pylist()] == [*range(len(texts)), 9]
    assert [w for _, words in made for w in words] == [words_of(t) for t in [*texts, "z"]]
    assert [len(words) for _, words in made] == [part.num_rows for part, _ in made] and max(len(words) for _, words in made) == 3
    assert ragged(np.array([4, 9, 0]), np.array([2, 0, 3])).tolist() == [4, 5, 0, 1, 2]


def test_signatures_grow_with_the_set():
    """Sets of a fifth of differences have many signatures that cover no element; their number grows in proportion all the same."""
    rng, highs, sets = np.random.default_rng(6), band_table(80, 30_000), []
    for size in (100, 1_000, 6_000, 24_000):
        x = np.unique(rng.integers(0, 2**48, size, dtype=np.uint64))
        sets += [x, np.sort(rng.permutation(x)[: -(-80 * len(x) // 100)])]
    sig, owner = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), highs, 80)
    for i, x in enumerate(sets):
        assert np.count_nonzero(owner == i) <= 2 * len(x)
    for i in range(0, len(sets), 2):
        assert np.intersect1d(sig[owner == i], sig[owner == i + 1]).size


def test_linked_sets_that_share_bare_signatures_alone_share_another(monkeypatch):
    """Whatever is bare in either partitioning, what two sets share in both is enough."""
    plain = jaccard.part_signatures

    def partly_bare(x, count, instance, k, seed):
        found, bare, cells = plain(x, count, instance, k, seed)
        return found, bare | np.isin(found, hidden[seed]), cells

    monkeypatch.setattr(jaccard, "part_signatures", partly_bare)
    x = np.unique(np.random.default_rng(7).integers(0, 2**48, 300, dtype=np.uint64))
    pair = [x, x[: -(-85 * len(x) // 100)]]
    highs, flat, bounds = band_table(85, 300), np.concatenate(pair), np.cumsum([0, *map(len, pair)])
    size, limits = np.diff(bounds), np.array(band_table(85, 300))
    shared = {}
    for seed in (0, 1):
        every = []
        for instance in (np.searchsorted(limits, size), np.searchsorted(limits, size) - 1):
            found, _, cells = plain(flat, size, instance, allowed_difference(limits[instance], 85), seed)
            every += [found[: cells[0]], found[cells[0] :]]
        shared[seed] = np.array([s for s in np.unique(np.concatenate(every)) if sum(s in e for e in every) > 1], np.uint64)
    for hidden in ([shared[0], []], [shared[0], shared[1]]):
        sig, owner = signatures(flat, bounds, highs, 85)
        assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size
