"""Operator 7: removal of byte strings that repeat anywhere in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.jaccard import mix
from wardbook.session import release, settle

GRAM = 32  # bytes whose hash is sampled
# Contexts of at most 2 * length - 32 bytes each: how many one group may have
# before it is split, and how many are sorted together at least.
GROUP_ROWS = 4_096
CHUNK_ROWS = 1_024
PIECE_BYTES = 1 << 20  # short texts are hashed together, so many bytes at a time
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(11).integers(1, 2**64 - 1, 256, np.uint64)


class Rolling:
    """64-bit hashes of any substrings of a text."""

    def __init__(self, data: np.ndarray):
        powers, back = np.full(len(data) + 1, _INVERSE), np.full(len(data) + 1, _BASE)
        powers[0] = back[0] = 1
        powers, self.back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * powers[:-1], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self) -> np.ndarray:
        """The hash of the gram at each place."""
        return mix((self.prefix[GRAM:] - self.prefix[:-GRAM]) * self.back[: -GRAM] + np.uint64(GRAM))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each window of w values, in two passes over blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w + w, np.uint64(2**64 - 1), np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchored(grams: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) for texts written one after the other that end at ``ends``.

    The anchor of a string of ``length`` bytes is its gram with the smallest
    hash, the first of equals, so equal strings have it at the same place.
    Strings with one anchor begin at neighbouring places, from first to last.
    """
    at = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least((grams >> np.uint64(32) << np.uint64(32)) | at, length - GRAM + 1)
    begin = np.arange(len(least))
    whole = begin + length <= ends[np.searchsorted(ends, begin, "right")]  # strings within one text
    begin, anchor = begin[whole], (least[whole] & np.uint64(2**32 - 1)).astype(np.int64)
    heads = np.flatnonzero(np.diff(anchor, prepend=-1))
    return anchor[heads], begin[heads], begin[np.append(heads[1:], len(begin)) - 1] if len(begin) else begin


def _data(value) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def occurrences(texts: DataFrame, length: int) -> DataFrame:
    """A row per anchor of a text and the context that its strings make up.

    doc, twin, p (the anchor's place), left (bytes of the context before it),
    size (of the context), a (the hash of the gram) and c (of the context).
    """

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
        rows, held, size = [], [], 0
        for i, value in enumerate(batch.column("text")):
            raw = _data(value).tobytes()
            if len(raw) >= length:
                rows.append(i)
                held.append(raw)
                size += len(raw)
            if size >= PIECE_BYTES:
                yield rows, held
                rows, held, size = [], [], 0
        if held:
            yield rows, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in pieces(batch):
                ends = np.cumsum([len(x) for x in held])
                roll = Rolling(np.frombuffer(b"".join(held), np.uint8))
                anchor, first, last = anchored(roll.grams(), ends, length)
                left, end = anchor - first, last + length
                text = np.searchsorted(ends, anchor, "right")
                place = anchor - np.concatenate([[0], ends])[text]
                same = pa.array(np.array(rows)[text])
                arrays = [batch.column("doc").take(same), batch.column("twin").take(same)]
                arrays += [pa.array(x.astype(np.int32)) for x in (place, left, end - first)]
                arrays += [_signed(roll(anchor, anchor + GRAM)), _signed(roll(first, end) ^ mix(left.astype(np.uint64)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "twin", "p", "left", "size", "a", "c"])

    return texts.select("doc", "twin", "text").mapInArrow(run, "doc bigint, twin int, p int, left int, size int, a bigint, c bigint")


def context_bytes(texts: DataFrame) -> DataFrame:
    """For each (p, left, size, a, n) in ``places``: the bytes of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            places = batch.column("places")
            counts = places.value_lengths().to_numpy()
            fields = {f.name: places.flatten().field(f.name) for f in places.type.value_type}
            p, left, size = (fields[c].to_numpy() for c in ("p", "left", "size"))
            first, ends = (p - left).tolist(), (p - left + size).tolist()
            cut: list[bytes] = []
            used = np.ones(len(p), bool)
            at = 0
            for doc, twin, value, count in zip(batch.column("doc").to_pylist(), batch.column("twin").to_pylist(), batch.column("text"), counts.tolist()):
                if (doc, twin) == before:  # a repeated row
                    used[at : at + count] = False
                else:
                    raw = _data(value).tobytes()
                    cut += [raw[first[k] : ends[k]] for k in range(at, at + count)]
                before, at = (doc, twin), at + count
            of = pa.array(np.repeat(np.arange(len(counts)), counts)[used])
            keep = pa.array(used)
            arrays = [fields["a"].filter(keep), fields["n"].filter(keep), batch.column("doc").take(of), batch.column("twin").take(of)]
            arrays += [fields["p"].filter(keep), fields["left"].filter(keep), pa.array(cut, pa.binary())]
            made = pa.RecordBatch.from_arrays(arrays, names=["a", "n", "doc", "twin", "p", "left", "ctx"])
            for start in range(0, len(made), 10_000):
                yield made.slice(start, 10_000)

    return texts.select("doc", "twin", "text", "places").mapInArrow(run, "a bigint, n bigint, doc bigint, twin int, p int, left int, ctx binary")


def two_stage_order(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that begin at ``starts`` (flags), ordered by their first ``depth`` bytes.

    Only suffixes smaller than their successors are sorted directly. Every
    other one is larger than its successor, so a scan of the buckets of first
    bytes in order, from each suffix to the one before it, finds them sorted.
    """
    n = len(data)
    text = np.append(data.astype(np.int16), np.int16(-1))
    slope = np.append(np.sign(text[1:] - text[:-1]), np.int16(1))  # the end is smaller than all
    known = np.where(slope != 0, np.arange(n + 1), n)
    smaller = slope[np.minimum.accumulate(known[::-1])[::-1]] > 0
    # What is induced needs its successors up to the next suffix sorted directly.
    after = np.minimum.accumulate(np.where(smaller, np.arange(n + 1), n)[::-1])[::-1]
    edge = np.zeros(n + 2, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, after[at] + 1, -1)
    needed = np.cumsum(edge)[: n + 1] > 0
    direct = np.flatnonzero(needed[:n] & smaller[:n])
    padded = np.append(data, np.zeros(depth, np.uint8))
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys)]
    induced = np.append(needed[:n] & ~smaller[:n], [False, False])  # the last flag answers for the place before the first
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(segment: np.ndarray, byte: int) -> None:
        before = segment - 1
        before = before[induced[before]]
        before = before[data[before] > byte]
        heads = data[before]
        before, heads = before[np.argsort(heads, kind="stable")], np.sort(heads)
        cuts = np.flatnonzero(np.diff(heads)) + 1
        for piece in np.split(before, cuts) if len(before) else ():
            buckets[data[piece[0]]].append(piece)

    order: list[np.ndarray] = []
    hand_on(np.array([n]), -1)
    ends = np.searchsorted(data[direct], np.arange(257))
    for byte in range(256):
        parts = [np.concatenate(buckets[byte])] if buckets[byte] else []
        while parts and len(parts[-1]):  # runs of one byte
            before = parts[-1] - 1
            before = before[induced[before]]
            parts.append(before[data[before] == byte])
        segment = np.concatenate([*parts, direct[ends[byte] : ends[byte + 1]]])
        if len(segment):
            order.append(segment)
            hand_on(segment, byte)
    found = np.concatenate(order) if order else np.empty(0, np.int64)
    return found[starts[found]]


def same_prefix(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of the order but the first: whether it shares ``length`` bytes with the one before."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)).view(np.uint64).ravel()
    alive = np.arange(1, len(order))
    for at in [*range(0, length - 7, 8), length - 8]:
        alive = alive[words[order[alive - 1] + at] == words[order[alive] + at]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[alive - 1] = True
    return out


def repeated_in(table: pa.Table, length: int) -> pa.RecordBatch:
    """Spans (doc, twin, s, e) of the contexts whose strings of ``length`` bytes start at another place, too."""
    docs, twins, p, left, n = (table[c].to_numpy() for c in ("doc", "twin", "p", "left", "n"))
    pieces = table["ctx"].to_pylist()
    sizes = np.array([len(x) for x in pieces])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    low = p.astype(np.int64) - left
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    starts = inside + length <= np.repeat(sizes, sizes)
    order = two_stage_order(data, starts, length)
    run = np.concatenate([[0], np.cumsum(~same_prefix(data, order, length))]) if len(order) else np.empty(0, np.int64)
    heads = np.flatnonzero(np.diff(run, prepend=-1))
    owner = np.searchsorted(offsets, order, "right") - 1
    _, who = np.unique(np.stack([docs, twins.astype(np.int64)]), axis=1, return_inverse=True)
    place = (who.ravel()[owner].astype(np.int64) << 32) + low[owner] + inside[order]
    again = np.zeros(0, bool)
    if len(order):
        again = (np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)) | (np.maximum.reduceat(n[owner], heads) > 1)
    marked = np.zeros(len(data) + 1, bool)
    marked[order[again[run]]] = True
    change = np.diff(marked.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1
    of = np.searchsorted(offsets, first, "right") - 1
    s, e = low[of] + inside[first], low[of] + inside[last] + length
    return pa.RecordBatch.from_arrays([pa.array(docs[of]), pa.array(twins[of]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc", "twin", "s", "e"])


SPAN = "doc bigint, twin int, s int, e int"


def sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The repeated spans of contexts of which those of one g are compared; a g has at most ``GROUP_ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < CHUNK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            g = table["g"].to_numpy()
            cuts = np.flatnonzero(np.diff(g)) + 1  # the last group goes on in the next batch, perhaps
            begin = 0
            for k, end in enumerate(cuts):
                if end - begin >= CHUNK_ROWS or k == len(cuts) - 1:
                    yield repeated_in(table.slice(begin, end - begin), length)
                    begin = end
            held = table.slice(begin).to_batches()
        if held:
            yield repeated_in(pa.Table.from_batches(held), length)

    # The end of a task's rows is a whole number of groups, so only memory bounds what one call sorts.
    return contexts.repartition("g").sortWithinPartitions("g").select("g", "doc", "twin", "p", "left", "n", "ctx").mapInArrow(run, SPAN)


def spans_by_sorting(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of all contexts that share a string of ``length`` bytes around the same gram, however many share a gram.

    A string lies ``r`` bytes before its anchor, with r in a range. Contexts of
    one gram meet in one group. Where that is larger than ``GROUP_ROWS``, the
    range is halved, and for each half contexts meet only if the bytes that
    all its strings hold are equal. When one r is left, the strings themselves
    are counted.
    """
    rows = contexts.withColumns({"g": F.col("a"), "r0": F.lit(0), "r1": F.lit(length - GRAM)})
    done, kept = [], []
    while True:
        sizes = rows.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > GROUP_ROWS)
        hot = settle(sizes.select("g"), "hot-groups")
        if hot.isEmpty():
            release(hot)
            done.append(sorted_spans(rows, length))
            break
        kept.append(hot)
        done.append(sorted_spans(rows.join(hot, "g", "left_anti"), length))
        crowd = rows.join(hot, "g", "left_semi")
        middle = F.floor((F.col("r0") + F.col("r1")) / 2).cast("int")
        halves = F.array(F.struct("r0", middle.alias("r1")), F.struct((middle + 1).alias("r0"), "r1"))
        crowd = crowd.withColumn("half", F.explode(halves)).withColumns({"r0": F.col("half.r0"), "r1": F.col("half.r1")}).drop("half")
        crowd = crowd.where((F.col("left") >= F.col("r0")) & (F.octet_length("ctx") - F.col("left") >= length - F.col("r1")))
        shared = F.expr(f"substring(ctx, left - r0 + 1, {length} - r1 + r0)")
        crowd = settle(crowd.withColumn("g", F.xxhash64("a", "r0", "r1", shared)), "crowded")
        kept.append(crowd)
        # The halving takes all ranges to one r in the same round or the one before.
        single = crowd.where("r0 = r1").withColumn("string", shared)
        again = single.groupBy("a", "r0", "string").agg(F.count("*").alias("m"), F.max("n").alias("most")).where("m > 1 OR most > 1")
        done.append(single.join(again, ["a", "r0", "string"], "left_semi").select("doc", "twin", (F.col("p") - F.col("r0")).alias("s"), (F.col("p") - F.col("r0") + length).alias("e")))
        rows = crowd.where("r0 < r1")
    out = settle(reduce(DataFrame.unionByName, done), "sorted-spans")
    release(*kept)
    return out


def cut_repeats(df: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, n_bytes, n_removed, n_spans, kept (the bytes that are left) and kept_sha256.

    Every byte is removed that lies in a string of ``length`` bytes which also
    starts anywhere else, be it in the same document. Overlaps count, and
    matches never cross documents. Null and empty texts have no bytes; texts
    may have any length; a repeated row is one more copy; other columns are
    left out, whatever their names; an empty table gives no rows.

    Equal strings contain the same sampled gram at the same place. So suffixes
    are sorted only among the surroundings of an equal gram: whole
    surroundings that occur again are settled by counting, and one copy of
    each different one goes into a two-stage suffix sort, where neighbours are
    compared byte by byte. All counts combine on the map side.
    """
    source = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = source.withColumns({"doc": F.xxhash64("key", "text"), "twin": F.hash("key", "text")})
    occ = settle(occurrences(texts, length), "anchors")
    # Any one place of a context will do; the three columns come from the same row, which hash aggregation keeps.
    one = [F.first(c).alias(c) for c in ("doc", "twin", "p")]
    contexts = settle(occ.groupBy("a", "c", "left", "size").agg(F.count("*").alias("n"), *one), "contexts")
    # Whole surroundings that occur more than once.
    whole = occ.join(contexts.where("n > 1").select("a", "c", "left", "size"), ["a", "c", "left", "size"], "left_semi")
    whole = settle(whole.select("doc", "twin", (F.col("p") - F.col("left")).alias("s"), (F.col("p") - F.col("left") + F.col("size")).alias("e")), "whole-spans")
    release(occ)
    # One place of each surrounding that shares its gram with another one.
    shared = contexts.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select("a")
    places = contexts.join(shared, "a", "left_semi").select("doc", "twin", "p", "left", "size", "a", "n")
    places = places.groupBy("doc", "twin").agg(F.collect_list(F.struct("p", "left", "size", "a", "n")).alias("places"))
    around = settle(context_bytes(texts.join(places, ["doc", "twin"])), "context-bytes")
    release(contexts)
    part = spans_by_sorting(around, length)
    release(around)
    spans = whole.unionByName(part).distinct().groupBy("doc", "twin").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    spans = settle(spans, "repeated-spans")
    release(whole, part)
    joined = texts.join(spans, ["doc", "twin"], "left").select("key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column("text"), batch.column("spans")):
                data = _data(value)
                edge = np.zeros(len(data) + 1, np.int64)
                for x in spans.as_py() or ():
                    edge[x["s"]] += 1
                    edge[min(x["e"], len(data))] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = data[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept, hashlib.sha256(kept).hexdigest()))
            n, removed, runs, kept, sha = zip(*rows) if rows else ((),) * 5
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    key_type = df.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {key_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
