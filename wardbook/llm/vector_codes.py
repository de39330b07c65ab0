"""Operator 11: vector code compression with slice-and-intersect bitmasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.vectors import matrix, whole_vectors
from wardbook.session import settle

CHUNK_ROWS = 1_024  # vectors searched at a time, which bounds a task's memory
# A component of this size or more has no code: squared distances of whole
# numbers below 2^26 fit a long for up to 512 dimensions.
LARGEST = 65_536.0


def _bits(n: int) -> np.ndarray:
    """A row per entry, with its bit set in words of 64."""
    numbers = np.arange(n)
    bits = np.zeros((n, (n + 63) // 64), np.uint64)
    bits[numbers, numbers // 64] = np.uint64(1) << (numbers % 64).astype(np.uint64)
    return bits


class EntryMasks:
    """The nearest entry of one codebook, found by intersecting coordinate ranges.

    Each dimension has its entries' coordinates in order, and for each place in
    that order a bitmask of the entries before it. The entries whose coordinate
    lies in a range are the difference of two such masks, and the AND over the
    dimensions is the set of entries in a box around the vector. An entry outside a box of radius r is
    further away than r, so the best entry inside is the nearest of all, ties
    included, once its distance is r or less; else the box grows.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, dims = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.ordered = np.ascontiguousarray(np.take_along_axis(entries, order, 0).T)
        bits = _bits(n)
        self.all = np.bitwise_or.reduce(bits, axis=0)
        self.before = np.zeros((dims, n + 1, bits.shape[1]), np.uint64)
        for dim in range(dims):
            self.before[dim, 1:] = np.bitwise_or.accumulate(bits[order[:, dim]], axis=0)
        # The box starts so large that it holds about one entry.
        reach = np.zeros((n, n), np.int64)
        for dim in range(dims):
            np.maximum(reach, np.abs(entries[:, dim, None] - entries[None, :, dim]), out=reach)
        near = np.ones((1, 1)) if n < 2 else reach[~np.eye(n, dtype=bool)].reshape(n, n - 1)
        self.start = max(1, int(np.median(near.min(1))))

    def inside(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of every entry within the box around its row, in order."""
        mask = np.tile(self.all, (len(x), 1))
        for dim, (ordered, before) in enumerate(zip(self.ordered, self.before)):
            low = np.searchsorted(ordered, x[:, dim] - radius, "left")
            high = np.searchsorted(ordered, x[:, dim] + radius, "right")
            mask &= before[high] ^ before[low]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest one of ties, and the squared distance."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        left, radius = np.arange(len(x)), np.full(len(x), self.start, np.int64)
        while len(left):
            row, entry = self.inside(x[left], radius[left])
            squared = ((x[left[row]] - self.entries[entry]) ** 2).sum(1)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
            least = np.minimum.reduceat(squared, starts) if len(row) else squared
            is_least = np.flatnonzero(squared == np.repeat(least, np.diff(np.r_[starts, len(row)])))
            first = is_least[np.r_[True, row[is_least][1:] != row[is_least][:-1]]] if len(row) else is_least
            found = left[row[starts]]
            sure = least <= radius[found] ** 2
            index[found[sure]], distance[found[sure]] = entry[first[sure]], least[sure]
            radius[left] *= 2
            # The best entry so far bounds the nearest one, so this box settles it.
            root = np.sqrt(least[~sure].astype(np.float64)).astype(np.int64)
            radius[found[~sure]] = root + 1
            left = np.setdiff1d(left, found[sure], assume_unique=True)
        return index, distance


@dataclass
class Codebooks:
    """Entries of each part position, (n, dims of the part) each; the driver and every task hold them.

    They have ``entries`` rows of the vectors' length, whatever the table.
    """

    parts: list[np.ndarray]

    @property
    def sha256(self) -> str:
        numbers = ",".join(str(n) for part in self.parts for n in part.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()

    def cuts(self) -> list[slice]:
        ends = np.cumsum([0, *(p.shape[1] for p in self.parts)])
        return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]


def _round(rows: DataFrame, books: Codebooks, length: int) -> Codebooks:
    """Codebooks whose used entries are the floored means of the parts nearest to them."""
    cuts = books.cuts()
    widest = max(c.stop - c.start for c in cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [EntryMasks(p) for p in books.parts]
        count = [np.zeros(len(p), np.int64) for p in books.parts]
        total = [np.zeros(p.shape, np.int64) for p in books.parts]
        for batch in batches:
            x = matrix(batch, length)
            for at in range(0, len(x), CHUNK_ROWS):
                for p, cut in enumerate(cuts):
                    part = x[at : at + CHUNK_ROWS, cut]
                    near, _ = masks[p].nearest(part)
                    count[p] += np.bincount(near, minlength=len(count[p]))
                    np.add.at(total[p], near, part)
        # A row per part and used entry of each task, whatever it has read.
        for p, (c, t) in enumerate(zip(count, total)):
            used = np.flatnonzero(c)
            if len(used):
                sums = [t[e].tolist() + [0] * (widest - t.shape[1]) for e in used]
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()), "n": pa.array(c[used]), "sums": pa.array(sums, pa.list_(pa.int64()))}
                )

    partial = rows.select("x").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    # Decimals, as sums over very many vectors may exceed a long.
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(widest)]
    parts = [p.copy() for p in books.parts]
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        book = parts[row["part"]]
        book[row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(book.shape[1])]
    return Codebooks(parts)


def _codes(rows: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """(key, label, code, error) of every row."""
    cuts = books.cuts()
    key, label = (rows.schema[c].dataType.simpleString() for c in ("key", "other_0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [EntryMasks(p) for p in books.parts]
        for batch in batches:
            x = matrix(batch, length)
            near = np.zeros((len(x), len(cuts)), np.uint8)
            error = np.zeros(len(x), np.int64)
            for at in range(0, len(x), CHUNK_ROWS):
                here = slice(at, at + CHUNK_ROWS)
                for p, cut in enumerate(cuts):
                    near[here, p], squared = masks[p].nearest(x[here, cut])
                    error[here] += squared
            code = [bytes(r).hex() for r in near]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("other_0"), pa.array(code, pa.string()), pa.array(error)], names=["key", "label", "code", "error"])

    return rows.mapInArrow(run, f"key {key}, label {label}, code string, error bigint")


def compress_vectors(
    df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, Codebooks]:
    """(key, code, error, label_error) per kept vector, and the codebooks.

    Components become floor(scale * x), vectors are cut into ``parts`` parts
    (equal ones; if the length is no multiple, later parts are longer by one at
    most). Each part position has a codebook of at most ``entries`` (256 at
    most) entries, at first the parts of the smallest keys, improved in
    ``rounds`` rounds of exact assignment and floored means. A code has two hex
    digits per part. ``label_error`` is the sum of ``error`` over equal labels,
    nulls together.

    Vectors that are null, hold null or non-finite components, components of
    ``LARGEST`` or more, or differ in length from most are left out (see
    ``whole_vectors``). A null key counts as the largest; equal keys are
    ordered by their vectors. Repeated rows give repeated rows. Fewer vectors
    than entries make smaller codebooks, no vectors no rows. Other columns are
    left out. Vectors are read once per round; a task sends one row per entry.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a codebook has 1 to 256 entries and a vector 1 part at least")
    rows, length = whole_vectors(df, key, vector, scale, LARGEST, label)
    rows = settle(rows, "whole-vectors")
    smallest = [r["x"] for r in rows.orderBy(F.asc_nulls_last("key"), "x").limit(entries).select("x").collect()]
    first = np.array(smallest, np.int64).reshape(len(smallest), length)
    ends = [length * p // parts for p in range(parts + 1)]
    books = Codebooks([first[:, a:b] for a, b in zip(ends[:-1], ends[1:])])
    if len(first):
        for _ in range(rounds):
            books = _round(rows, books, length)
    coded = settle(_codes(rows, books, length), "vector-codes")
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error"), books
