"""Byte-pair merging on ragged numpy arrays, and fast cutting of texts into cached chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

NO_RANK = np.int64(1 << 40)
# Entries kept by a worker between batches. A full cache starts anew, which
# costs time but changes no result.
CACHE_ENTRIES = 400_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class PairTable:
    """Rank and product of each mergeable pair, looked up for whole arrays by two-level hashing."""

    BITS = 21

    def __init__(self, pairs: np.ndarray, products: np.ndarray, n_symbols: int):
        self.n_symbols = np.int64(n_symbols)
        self.product = products
        keys = pairs[:, 0] * self.n_symbols + pairs[:, 1]
        ranks = np.arange(len(keys), dtype=np.int64)
        slot = self._slot(keys)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NO_RANK, np.int64)
        self.keys[slot[::-1]], self.ranks[slot[::-1]] = keys[::-1], ranks[::-1]
        lost = self.keys[slot] != keys  # pairs whose slot went to another pair
        order = np.argsort(keys[lost])
        self.more_keys, self.more_ranks = keys[lost][order], ranks[lost][order]
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[slot[lost]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.n_symbols + right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NO_RANK)
        other = np.flatnonzero((out == NO_RANK) & self.shared[slot])
        if len(other) and len(self.more_keys):
            at = np.minimum(np.searchsorted(self.more_keys, keys[other]), len(self.more_keys) - 1)
            hit = self.more_keys[at] == keys[other]
            out[other[hit]] = self.more_ranks[at[hit]]
        return out


class Merger:
    """Rank-synchronous byte-pair merging of many pre-tokens at once.

    All pre-tokens of a batch lie behind each other in one array of symbols. In
    each round every pre-token merges all occurrences of its own lowest-ranked
    pair, from left to right. This equals merging one pair at a time because a
    pair made by a merge always ranks after it, which is checked on loading.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        model = self.spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], np.int64)
        self.last_id = np.array([vocab[s + end] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if a + b in made or max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError("a merge is used before it is made, so pairs can't be merged together")
            made[a + b] = rank
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        products = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.table = PairTable(pairs, products, max(vocab.values()) + 1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.byte_id[data]
        ends = np.cumsum(lengths)
        full = lengths > 0
        symbol[ends[full] - 1] = self.last_id[data[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        while len(symbol):
            rank = np.full(len(symbol), NO_RANK)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.table.rank(symbol[same], symbol[same + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbol)])
            best_here = np.repeat(best, size)
            over = best_here == NO_RANK  # words that can't merge any more leave the batch
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
                keep = ~over
                symbol, word, rank, best_here = symbol[keep], word[keep], rank[keep], best_here[keep]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best_here)
            # Of overlapping occurrences (a a a) every second one is taken, from the left.
            begins = np.r_[True, np.diff(at) != 1]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            symbol[at] = self.table.product[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, word = symbol[stays], word[stays]
        if not done_word:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))


# Characters on which Python's character classes and those of the vocabularies'
# patterns agree: printable ASCII, common white space, Latin letters.
ORDINARY = re.compile("[^\n\r\t\x20-\x7eÀ-ÖØ-öø-İĲ-ňŊ-ž]")


class ChunkCache:
    """What a function makes of each chunk, remembered by the worker process."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = CACHE_ENTRIES):
        self.compute, self.most, self.known = compute, most, {}

    def fill(self, chunks: set[str]) -> dict[str, object]:
        missing = [c for c in chunks if c not in self.known]
        if missing:
            if len(self.known) + len(missing) > self.most:
                self.known = {}
                missing = list(chunks)
            self.known.update(zip(missing, self.compute(missing)))
        return self.known


def cut_at(texts: list[str], special: dict[str, int]) -> re.Pattern | None:
    """A pattern of the special strings, if any text has one."""
    pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    return pattern if any(s in t for t in texts for s in special) else None
