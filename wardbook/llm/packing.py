"""Operator 3: packing documents into sequences by dominance reduction and best fit.

Lengths are whole numbers up to the capacity, so an instance of any size is a
histogram with as many entries as the capacity. The reduction and the fit work
on that histogram and place thousands of equal pieces in one step; the plan
they give is joined back to the pieces by length and rank.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardbook.llm.token_count import groups_by_size
from wardbook.llm.tokens import ORDINARY, ChunkCache, Merger, byte_symbols, cut_at
from wardbook.session import settle

# The vocabulary's own pre-token pattern, for ordinary characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# White space that isn't one space between two words.
UNEVEN_SPACE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
GROUP_CHARS = 4_000_000
CACHE_CHUNKS = 1_000_000  # chunks a worker remembers, about 200 bytes each; a full cache starts anew
FIRST = "\0"  # marks a chunk at the beginning of a text, which has no space before it


class TextEncoder:
    """Token ids of whole texts as little-endian 32-bit numbers, for a byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merger = Merger(path)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.cache = ChunkCache(self._encode_chunks, CACHE_CHUNKS)

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        ids, counts = self.merger.merge(words)
        data = ids.astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        # A chunk of letters is one word with the space before it.
        found = [(" " + c,) if c.isalpha() else PRE_TOKEN.findall(c[1:] if c[0] == FIRST else " " + c) for c in chunks]
        distinct = list(dict.fromkeys(chain.from_iterable(found)))
        known = dict(zip(distinct, self._encode_words([w.encode() for w in distinct])))
        return [known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws)) for ws in found]

    def _unusual(self, text: str) -> bytes:
        pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return b"".join(self._encode_words([bytes(map(self.byte_of.__getitem__, p)) for p in pieces]))

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {s: np.uint32(i).astype("<u4").tobytes() for s, i in self.merger.special.items()}
        pattern = cut_at(texts, self.merger.special)
        done: list[list] = []
        wanted: set[str] = set()
        for text in texts:
            parts: list = []
            marks = pattern.findall(text) if pattern else []
            for k, piece in enumerate(pattern.split(text) if marks else [text]):
                if k:
                    parts.append(special[marks[k - 1]])
                if not piece:
                    continue
                if ORDINARY.search(piece):
                    parts.append(self._unusual(piece))
                    continue
                if piece[0] == " " or piece[-1] == " " or any(s in piece for s in UNEVEN_SPACE):
                    chunks = [FIRST + piece]
                else:
                    chunks = piece.split(" ")
                    chunks[0] = FIRST + chunks[0]
                wanted.update(chunks)
                parts.append(chunks)
            done.append(parts)
        known = self.cache.fill(wanted)
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(known.__getitem__, p)) for p in parts) for parts in done]


_ENCODERS: dict[str, TextEncoder] = {}


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: whole sequences, the first piece takes what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(df: DataFrame, vocabulary: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """A row per piece with its checksum, the task that made it and its rank among that task's equal lengths."""
    key_type = df.schema[key].dataType
    schema = f"{key} {key_type.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local_rank bigint"
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = TextEncoder(vocabulary)
        encoder, part, seen = _ENCODERS[vocabulary], TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for group in groups_by_size(texts, GROUP_CHARS):
                for i, data in zip(range(group.start, group.stop), encoder.encode(texts[group])):
                    ids = data + end
                    for piece, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        rows.append((i, piece, start, length, crc, seen[length]))
                        seen[length] += 1
            at, piece, start, length, crc, rank = map(np.array, zip(*rows)) if rows else [np.empty(0, np.int64)] * 6
            arrays = [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            arrays += [pa.array(crc, pa.int64()), pa.array(np.full(len(at), part), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    return df.select(key, text).mapInArrow(run, schema)


@dataclass
class Kind:
    """A number of sequences that hold the same lengths: (length, how many, offset) in order of placing."""

    count: int
    free: int
    holds: tuple[tuple[int, int, int], ...]


def dominant_sets(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Fix sets that provably dominate every alternative for their largest piece, and take them out of ``counts``.

    From the longest length down, after Martello and Toth: a piece that no
    other fits next to stands alone; a piece whose best single partner fills
    the sequence, or is at least as long as any two partners that fit together
    where three don't, goes with that partner. Each case leaves no solution
    with fewer sequences. A length is looked at again until nothing is fixed.
    """
    fixed: list[Kind] = []

    def smallest(k: int) -> list[int]:
        out: list[int] = []
        for s in np.flatnonzero(counts):
            out += [int(s)] * min(int(counts[s]), k - len(out))
            if len(out) == k:
                break
        return out

    def fix(lengths: tuple[int, ...], times: int) -> None:
        holds, offset = [], 0
        for s in lengths:
            holds.append((s, 1, offset))
            offset += s
            counts[s] -= times
        fixed.append(Kind(times, capacity - offset, tuple(holds)))

    for j in range(capacity, 0, -1):
        while counts[j]:
            counts[j] -= 1  # one piece of this length is placed, the others may be its partners
            partners = np.flatnonzero(counts[: capacity - j + 1])
            small = smallest(3)
            counts[j] += 1
            if not len(partners):
                fix((j,), int(counts[j]))
                continue
            best = int(partners[-1])
            most = int(counts[j]) // 2 if best == j else int(min(counts[j], counts[best]))
            if j + best == capacity:
                fix((j, best), most)
                continue
            alone = len(small) < 2 or j + small[0] + small[1] > capacity  # no two partners fit
            if not alone and (len(small) < 3 or j + sum(small) > capacity):
                alone = best >= _best_two(counts, j, capacity)
            if not alone:
                break
            # The partners left change with every set that is fixed, but not
            # before the best one runs out.
            fix((j, best), most)
    return fixed


def _best_two(counts: np.ndarray, j: int, capacity: int) -> int:
    """The largest sum of two other pieces that fits next to one of length j."""
    counts = counts.copy()
    counts[j] -= 1
    room = capacity - j
    sizes = np.flatnonzero(counts[: room + 1])
    best, high = 0, len(sizes) - 1
    for low, a in enumerate(sizes):
        while high >= low and a + sizes[high] > room:
            high -= 1
        if high < low:
            break
        other = high
        if other == low and counts[a] < 2:
            continue
        best = max(best, int(a + sizes[other]))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Best fit in order of decreasing length, with equal pieces and equal sequences handled together."""
    by_free: dict[int, list[Kind]] = defaultdict(list)

    def put(kind: Kind, times: int, s: int, q: int) -> None:
        used = capacity - kind.free
        new = Kind(times, kind.free - s * q, (*kind.holds, (s, q, used)))
        kind.count -= times
        by_free[new.free].append(new)

    for s in range(capacity, 0, -1):
        left = int(counts[s])
        for free in range(s, capacity):
            if not left:
                break
            for kind in by_free.pop(free, []) if by_free.get(free) else []:
                q = free // s
                times = min(kind.count, left // q) if left else 0
                if times:
                    left -= times * q
                    put(kind, times, s, q)
                if kind.count and 0 < left < q:  # the last sequence gets fewer
                    put(kind, 1, s, left)
                    left = 0
                if kind.count:
                    by_free[free].append(kind)
        if left:
            q = capacity // s
            fresh = Kind(-(-left // q), capacity, ())
            full = left // q
            if full:
                put(fresh, full, s, q)
            if left % q:
                put(fresh, 1, s, left % q)
    return [k for kinds in by_free.values() for k in kinds if k.count]


def plan(counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Which ranks of each length go to which sequences, for a histogram of lengths.

    Pieces of a length with ranks from ``first`` on fill ``count`` sequences
    from ``sequence`` on, ``each`` per sequence, beginning at ``offset``.
    """
    rest = counts.astype(np.int64).copy()
    kinds = dominant_sets(rest, capacity) + best_fit(rest, capacity)
    rows, sequence = [], 0
    used: dict[int, int] = defaultdict(int)
    for kind in kinds:
        for s, q, offset in kind.holds:
            rows.append((s, used[s], sequence, kind.count, q, offset))
            used[s] += kind.count * q
        sequence += kind.count
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "count", "each", "offset"]).astype(np.int64)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Append sequence_id and offset to pieces that carry (length, part, local_rank).

    The plan has a few rows per length whatever the number of pieces, so each
    task carries it whole.
    """
    cells = pieces.groupBy("length", "part").agg((F.max("local_rank") + 1).alias("n"))
    cells = settle(cells, "length-counts")
    histogram = cells.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most one row per possible length
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    table = plan(counts, capacity).sort_values(["length", "first"])
    of_length = {int(s): g.to_numpy() for s, g in table.groupby("length")}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    ranked = ranked.drop("part", "local_rank", "before")
    schema = ranked.drop("rank").select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                mine = np.flatnonzero(length == s)
                entry = of_length[int(s)]
                e = entry[np.searchsorted(entry[:, 1], rank[mine], side="right") - 1]
                within = rank[mine] - e[:, 1]
                sequence[mine] = e[:, 2] + within // e[:, 4]
                offset[mine] = e[:, 5] + within % e[:, 4] * s
            batch = batch.drop_columns(["rank"])
            columns = [*batch.columns, pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(
    df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its token ids followed by ``end_id``; one longer than a
    sequence is cut into whole sequences, of which the first may be shorter.
    Returns a row per piece: key, piece, start, length, ids_crc32, sequence_id
    and offset. A null text counts as empty and makes a piece of one token;
    repeated rows are packed each; other columns are left out. An empty table
    gives no rows. Texts are tokenised once: the pieces are written to the
    shared folder, so their ranks stay fixed if executors are lost.
    """
    pieces = settle(tokenised_pieces(df, vocabulary, capacity, end_id, key, text), "pieces")
    return pack_pieces(pieces, capacity)
