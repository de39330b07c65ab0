"""Operator 10: exact token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.tokens import ORDINARY, ChunkCache, Merger, cut_at

# The vocabulary's own pre-token pattern, for ordinary characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Texts counted together; long texts make smaller groups.
GROUP_CHARS = 4_000_000


class WordCounter:
    """Counts tokens of whole texts for a word-end byte-pair vocabulary file.

    Ordinary texts are cut at white space and each distinct chunk is
    pre-tokenised and merged once. Texts with other characters take the
    library's own normaliser and pre-tokeniser before the same merging.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merger = Merger(path)
        self.library = Tokenizer.from_file(path)
        self.cache = ChunkCache(self._count_chunks)

    def _merged_counts(self, words: list[str]) -> np.ndarray:
        return self.merger.merge([w.encode() for w in words])[1]

    def _count_chunks(self, chunks: list[str]) -> list[int]:
        found = [PRE_TOKEN.findall(c) for c in chunks]
        flat = [w for ws in found for w in ws]
        distinct = list(dict.fromkeys(flat))
        counts = dict(zip(distinct, self._merged_counts(distinct).tolist()))
        return [sum(map(counts.__getitem__, ws)) for ws in found]

    def _unusual(self, text: str) -> int:
        """A text with characters whose classes might be read differently."""
        normal = self.library.normalizer.normalize_str(text)
        pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        table = _byte_of()
        return int(self.merger.merge([bytes(map(table.__getitem__, p)) for p in pieces])[1].sum())

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        pieces: list[tuple[int, str]] = []
        pattern = cut_at(texts, self.merger.special)
        for i, text in enumerate(texts):
            if pattern and pattern.search(text):
                parts = pattern.split(text)
                out[i] += len(parts) - 1
                pieces += [(i, p) for p in parts]
            else:
                pieces.append((i, text))
        plain = []
        for i, piece in pieces:
            if ORDINARY.search(piece):
                out[i] += self._unusual(piece)
            else:
                plain.append((i, piece.lower().split()))
        known = self.cache.fill({c for _, chunks in plain for c in chunks})
        for i, chunks in plain:
            out[i] += sum(map(known.__getitem__, chunks))
        return out


def _byte_of() -> dict[str, int]:
    from wardbook.llm.tokens import byte_symbols

    return {s: b for b, s in enumerate(byte_symbols())}


_COUNTERS: dict[str, WordCounter] = {}


def _counter(path: str) -> WordCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


def groups_by_size(texts: list[str], limit: int) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", output: str = "n_tokens") -> DataFrame:
    """Append the number of tokens of each text under a vocabulary file.

    The file must lie at the same path on every executor. Any column may be
    null; a null text counts as empty (0 tokens), repeated rows are counted
    each, and a column already called as the output is replaced. Rows stay in
    their partitions: nothing is shuffled, and texts of any length are counted
    whole.
    """
    kept = df.drop(output) if output != text else df
    schema = kept.select("*", F.lit(0).cast("bigint").alias(output)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts: list[int] = []
            for part in groups_by_size(texts, GROUP_CHARS):
                counts += counter.count(texts[part])
            columns = [*batch.columns, pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, output])

    return kept.mapInArrow(run, schema)
