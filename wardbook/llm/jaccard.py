"""Operator 4: Jaccard join of word shingle sets by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardbook.llm.graph import components
from wardbook.session import settle

# Shingles are 48-bit hashes: two shingles of one pair of sets collide with a
# chance of about 1e-9.
SHINGLE_BITS = 48
SKETCH_SEED = 0x5BD1E9955BD1E995
SUBPARTS = 3  # parts of a partition, of which each signature leaves out one
SKETCH_BITS_PER_DIFFERENCE = 8  # the smallest size of a parity sketch, per difference that linked sets may have
CACHE_WORDS = 100_000
PACKED_SIGNATURES = 500_000  # signatures that a task holds before it passes them on by bucket
WORDS_AT_ONCE = 200_000  # texts are hashed together until they have so many words
TEXTS_AT_ONCE = 4_096  # at most 2^16: a text's number stands above its shingles
LABELS_TRIED = 64  # numbers tried per partition, so that each has one of its own
TILE_ROWS = 256  # classes on a side of a tile, in which each is compared with each
PAIRS_AT_ONCE = 1_000_000  # pairs of classes, or words of their sketches, that are compared together


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges that begin at ``first`` and have ``count`` numbers, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of batches of (key, text), with the words of their texts, so small that their arrays stay in the cache."""
    for batch in batches:
        at, held, words = 0, 0, []
        for i, t in enumerate(batch.column(1)):
            words.append(words_of(t.as_py()))
            held += len(words[-1])
            if held >= WORDS_AT_ONCE or len(words) == TEXTS_AT_ONCE:
                yield batch.slice(at, len(words)), words
                at, held, words = i + 1, 0, []
        if words:
            yield batch.slice(at), words


class ShingleHasher:
    """Sorted distinct shingle hashes of texts, given by their words; remembers the hashes of words."""

    def __init__(self, width: int):
        self.width, self.known = width, _WordHashes()

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts, text by text, and where those of each begin and the last end."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size) - size
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.uint64, int(size.sum()))
        found = []
        for n in range(1, self.width + 1):  # fewer words than the width are one shingle
            of = np.flatnonzero(size >= n if n == self.width else size == n)
            count = size[of] - n + 1
            at = ragged(first[of], count)
            out = np.full(len(at), n, np.uint64)
            for k in range(n):
                out *= np.uint64(0x9E3779B97F4A7C15)
                out += h[at + k]
                out = mix(out)
            out >>= np.uint64(64 - SHINGLE_BITS)
            found.append(out | (np.repeat(of, count).astype(np.uint64) << np.uint64(SHINGLE_BITS)))
        x = np.sort(np.concatenate(found))  # by text, then hash
        x = x[np.append(True, x[1:] != x[:-1])] if len(x) else x
        bounds = np.searchsorted(x, np.arange(len(texts), dtype=np.uint64) << np.uint64(SHINGLE_BITS))
        return x & np.uint64(2**SHINGLE_BITS - 1), np.append(bounds, len(x))


def band_table(percent: int, upto: int) -> list[int]:
    highs, low = [], 1
    while not highs or highs[-1] < upto:
        highs.append(max(low, low * 100 // percent))
        low = highs[-1] + 1
    return highs


def allowed_difference(high: int, percent: int) -> int:
    """Most differing elements of two linked sets of which the smaller has at most ``high`` elements."""
    total = high + high * 100 // percent
    return (100 - percent) * total // (100 + percent)


def parity_sketch(x: np.ndarray, percent: int) -> np.ndarray:
    """Per cell of the hashed domain, whether an odd number of elements fall there, packed into 64-bit words.

    An element that only one of two sets has flips one bit, so two sketches
    differ in at most as many bits as their sets in elements. The size is a
    power of two that grows with the set. A sketch is folded to half its size
    by xor of its halves, and linked sets differ in size at most by that.
    """
    words = max(1, SKETCH_BITS_PER_DIFFERENCE * allowed_difference(len(x), percent) // 64)
    bits = 64 << (words - 1).bit_length()
    cell = (mix(x + np.uint64(SKETCH_SEED)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of one size, folded to so many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def pairs_within(tile: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows, sorted by tile and side, that share a tile: of both sides if it has two, or any; some ``PAIRS_AT_ONCE`` at a time."""
    at = np.arange(len(tile))
    edge = np.append(True, tile[1:] != tile[:-1])
    number = np.cumsum(edge) - 1
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(tile))[number]
    second = begin + np.add.reduceat((side == 0).astype(np.int64), begin)  # where the second side begins
    crossed = (second > begin) & (second < np.append(begin[1:], len(tile)))
    first = np.where(crossed[number], np.maximum(second[number], at + 1), at + 1)
    count = np.where(crossed[number] & (side == 1), 0, end - first)
    done = np.cumsum(count)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
        yield np.repeat(at[i:j], count[i:j]), ragged(first[i:j], count[i:j])
        i = j


def linkable(x: np.ndarray, y: np.ndarray, n: np.ndarray, flat: np.ndarray, first: np.ndarray, words: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of classes can be similar enough, by size and sketch, as ``may_link`` says."""
    nx, ny = n[x], n[y]
    ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    left = np.flatnonzero(ok)
    kind = words[x[left]] << 32 | words[y[left]]
    for k in np.unique(kind):
        wx, wy = int(k >> 32), int(k & (2**32 - 1))
        of, step = left[kind == k], max(1, PAIRS_AT_ONCE // max(wx, wy))
        for i in range(0, len(of), step):
            some = of[i : i + step]
            a, b = (folded(flat[first[at[some]][:, None] + np.arange(w)], min(wx, wy)) for at, w in ((x, wx), (y, wy)))
            apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            ok[some] = (100 + percent) * apart <= (100 - percent) * (nx[some] + ny[some])
    return ok


def may_link(percent: int) -> str:
    """Whether two classes, by size and sketch (nx, px, ny, py), can be similar enough: never false for a link."""
    size = "least(size(px), size(py))"
    half = lambda p: f"(get({p}, i) ^ CASE WHEN size({p}) > {size} THEN get({p}, i + {size}) ELSE 0L END)"
    apart = f"aggregate(sequence(0, {size} - 1), 0, (sum, i) -> sum + bit_count({half('px')} ^ {half('py')}))"
    sizes = f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)"
    return f"{sizes} AND {100 + percent} * {apart} <= {100 - percent} * (nx + ny)"


def part_signatures(x: np.ndarray, count: np.ndarray, instance: np.ndarray, k: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets, given one after the other by their sizes; which of them cover no element; how many each set has.

    The domain is cut into ``k // 2 + 1`` partitions, so that two sets with at
    most ``k`` differences have at most one in some partition. Each partition
    is cut into three, and a signature covers two of them: the one without the
    difference is shared.
    """
    cells = (k // 2 + 1) * SUBPARTS
    first = np.cumsum(cells) - cells
    total = int(cells.sum())
    hashed = mix(x + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64))
    cell = (hashed % np.repeat(cells.astype(np.uint64), count)).astype(np.int64) + np.repeat(first, count)
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, cell, mix(hashed))
    sums, held = sums.reshape(-1, SUBPARTS), np.bincount(cell, minlength=total).reshape(-1, SUBPARTS)
    rest = (sums.sum(1, dtype=np.uint64)[:, None] - sums).ravel()
    bare = (held.sum(1)[:, None] - held).ravel() == 0
    place = np.arange(total) - np.repeat(first - (instance << 32) - (seed << 56), cells)
    return mix(rest + mix(place.astype(np.uint64))), bare, cells


def signatures(x: np.ndarray, bounds: np.ndarray, highs: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of sets, for the size band of each and for the one below, and the number of the set that each belongs to.

    A signature without elements would be shared by unrelated sets. A set with
    such ones gets the signatures of a second, independent partitioning as
    well, of which linked sets share one, too. Only where both are without
    elements are they combined: few until a set has some 100,000 elements,
    from where their number, which grows with its square, counts.
    """
    size, limits = np.diff(bounds), np.array(highs)
    band = np.searchsorted(limits, size)
    out, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for instance in (band, band - 1):
        k = np.where(instance >= 0, allowed_difference(limits[instance], percent), 0)
        of = np.flatnonzero((k > 0) & (size > 0))  # without a difference only equal sets are linked, and those are one class already
        if len(of) == 0:
            continue
        found, bare, cells = part_signatures(x[ragged(bounds[of], size[of])], size[of], instance[of], k[of], 0)
        owner = np.repeat(of, cells)
        out.append(found[~bare])
        owners.append(owner[~bare])
        if bare.any():
            of, at = np.unique(owner[bare], return_inverse=True)
            second, bare_too, cells = part_signatures(x[ragged(bounds[of], size[of])], size[of], instance[of], k[of], 1)
            whose = np.repeat(np.arange(len(of)), cells)
            out.append(second[~bare_too])
            owners.append(of[whose[~bare_too]])
            count = np.bincount(whose[bare_too], minlength=len(of))
            with_ = second[bare_too][ragged((np.cumsum(count) - count)[at], count[at])]
            out.append(mix(with_ ^ np.repeat(mix(found[bare]), count[at])))
            owners.append(np.repeat(of[at], count[at]))
    return np.concatenate(out), np.concatenate(owners)


def shingle_sets(df: DataFrame, key: str, text: str, width: int, percent: int | None = None) -> DataFrame:
    """Per row: key, n, digest and the parity sketch for ``percent``; without it, the shingles instead of a sketch."""
    key_type = df.schema[key].dataType.simpleString()
    last = "shingles" if percent is None else "sketch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for part, words in in_chunks(batches):
            x, bounds = hasher(words)
            sets = [x[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            digest = pa.array([xxhash.xxh3_128_hexdigest(one.tobytes()) for one in sets])
            if percent is None:
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x.view(np.int64)))
            else:
                lists = pa.array([parity_sketch(one, percent) for one in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), digest, lists], names=["key", "n", "digest", last])

    return df.select(key, text).mapInArrow(run, f"key {key_type}, n bigint, digest string, {last} array<bigint>")


def partition_labels(spark: SparkSession) -> np.ndarray:
    """Per shuffle partition a number that Spark's hash sends there; a partition that none of the tried ones meets gets any other."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = spark.range(LABELS_TRIED * parts).selectExpr("id", f"pmod(hash(id), {parts}) AS part").groupBy("part").agg(F.min("id").alias("id"))
    labels = -1 - np.arange(parts)
    for row in met.collect():  # a row per partition
        labels[row["part"]] = row["id"]
    return labels


def signature_rows(df: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(bucket, sig, d): the signatures of every row that has words, dealt out by bucket.

    A row per signature would take far more room in the shuffle than the
    signature itself. Each task therefore packs its signatures into a pair of
    arrays per bucket, a range of signatures, and they are spread out after
    the shuffle. Each shuffle partition takes one bucket, so a task makes no
    more rows than the shuffle has blocks, and the partitions are even. A
    bucket and 32 more bits stand for a signature; chance sharing only adds a
    pair to verify.
    """
    key_type = df.schema[key].dataType.simpleString()
    labels = partition_labels(df.sparkSession)

    def packed(keys: list[pa.Array], found: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        sig, owner = np.concatenate(found), np.concatenate(owners)
        bucket = ((sig >> np.uint64(32)) * np.uint64(len(labels))) >> np.uint64(32)
        bucket = bucket.astype(np.uint16 if len(labels) < 2**16 else np.int64)  # short numbers are sorted by radix
        order = np.argsort(bucket, kind="stable")  # rows stay in order, so their keys compress well
        present, first = np.unique(bucket[order], return_index=True)
        ends = pa.array(np.append(first, len(sig)), pa.int32())
        sigs = pa.ListArray.from_arrays(ends, pa.array(sig[order].astype(np.uint32).view(np.int32)))
        ids = pa.ListArray.from_arrays(ends, pa.concat_arrays(keys).take(pa.array(owner[order])))
        return pa.RecordBatch.from_arrays([pa.array(labels[present]), sigs, ids], names=["bucket", "sig", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, highs = ShingleHasher(width), band_table(percent, 1)
        keys, found, owners, texts, held = [], [], [], 0, 0
        for part, words in in_chunks(batches):
            x, bounds = hasher(words)
            if (most := int(np.diff(bounds).max())) > highs[-1]:
                highs = band_table(percent, most)
            sig, owner = signatures(x, bounds, highs, percent)
            keys.append(part.column(0))
            found.append(sig)
            owners.append(owner + texts)
            texts, held = texts + len(words), held + len(sig)
            if held >= PACKED_SIGNATURES:
                yield packed(keys, found, owners)
                keys, found, owners, texts, held = [], [], [], 0, 0
        if held:
            yield packed(keys, found, owners)

    rows = df.select(key, text).mapInArrow(run, f"bucket bigint, sig array<int>, d array<{key_type}>")
    return rows.repartition("bucket").selectExpr("bucket", "inline(arrays_zip(sig, d))")


def jaccard_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest key reachable by links.

    Rows link if 100 * intersection >= percent * union of their distinct
    word shingles. Words are cut at ASCII white space, A-Z in lower case; fewer
    words than ``width`` are one shingle. A null text or one without words has
    no shingles and no links. Keys are not null and distinct for different
    texts; repeated rows give a row each and share a component. An empty table gives no rows; other columns are
    left out.

    Rows with equal sets form a class, and only classes are compared. First
    each class that shares a signature is compared with the smallest one there,
    which joins most groups of near copies. Then classes that share a
    signature and are still apart are compared with each other, each pair once
    and not for each signature that it shares. Sizes and parity sketches come
    first: what they rule out can't be a link, and only the other pairs meet
    with their shingles.
    """
    base = settle(shingle_sets(df, key, text, width, percent), "digests")
    one = base.where("n > 0").groupBy("digest").agg(F.min("key").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = settle(one, "classes")
    base = base.drop("sketch")
    signed = signature_rows(of_keys(df, classes, key, text), key, text, width, percent)
    # A signature that one class has alone can't give a link. One shuffle finds the smallest class and tells who is alone.
    # Signatures come before buckets, as rows are sorted by the first column, and a partition has one bucket.
    by_class = Window.partitionBy("sig", "bucket").orderBy("d")
    whole = F.expr("shiftleft(bucket, 32) | (sig & 4294967295L)").alias("sig")
    members = signed.select(whole, "d", F.first("d").over(by_class).alias("hub"), F.lead("d").over(by_class).alias("after"))
    members = settle(members.where("d != hub OR after IS NOT NULL").select("sig", "d", "hub"), "members")
    class_of = lambda at: classes.select(F.col("id").alias(at), F.col("n").alias(f"n{at}"), F.col("sketch").alias(f"p{at}"))
    hubs = members.where("d != hub").select(F.col("hub").alias("x"), F.col("d").alias("y")).distinct()
    first = settle(hubs.join(class_of("x"), "x").join(class_of("y"), "y").where(may_link(percent)).select("x", "y"), "hub-pairs")
    links = verified_links(df, first, key, text, width, percent)
    label = settle(components(links.select("a", "b")), "first-components")
    placed = members.join(label.withColumnRenamed("node", "d"), "d", "left").select("sig", "d", F.coalesce("component", "d").alias("c"))
    groups = placed.groupBy("sig").agg((F.min("c") != F.max("c")).alias("apart"), F.min("d").alias("hub"), F.count("*").alias("m"))
    placed = settle(placed.join(groups.where("apart").drop("apart"), "sig"), "apart")
    second = near_pairs(placed, classes, percent).join(first, ["x", "y"], "left_anti")
    links = links.select("a", "b").union(verified_links(df, second, key, text, width, percent).select("a", "b"))
    # The smallest class id of a component is also its smallest key.
    label = components(links).select(F.col("node").alias("id"), "component")
    placed = classes.join(label, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = base.join(placed, "digest", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def near_pairs(placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(x, y), x < y: the pairs of classes in different components that share a signature and that size and sketch allow.

    ``placed`` has the classes of each signature (sig, d, component c) with
    the smallest class (hub) and the number (m) of its classes. Near copies
    share hundreds of signatures, mostly of one hub, so the classes of a hub
    are compared with each other at once, as a block; if those of its
    signatures one by one make far fewer pairs, each is a block instead. More
    pairs may be compared than share a signature, which only shows again what
    is or isn't a link. A block is cut into tiles of at most about twice
    ``TILE_ROWS`` rows, so no task has a whole one.
    """
    key_type = classes.schema["id"].dataType.simpleString()
    of_hub = settle(placed.groupBy("hub", "d").agg(F.first("c").alias("c"), F.sum("m").alias("m")), "hub-members")
    hubs = settle(of_hub.groupBy("hub").agg(F.count("*").alias("size"), F.sum("m").alias("by_sig")).withColumn("whole", F.expr("double(size) * size <= 4 * by_sig")), "hubs")
    blocks = of_hub.join(hubs.where("whole"), "hub").select(F.xxhash64("hub").alias("block"), "d", "c", "size")
    rest = placed.join(hubs.where("NOT whole").select("hub"), "hub", "left_semi").select(F.xxhash64("hub", "sig").alias("block"), "d", "c", F.col("m").alias("size"))
    rows = blocks.unionByName(rest).withColumn("parts", F.expr(f"(size + {TILE_ROWS - 1}) div {TILE_ROWS}")).withColumn("part", F.expr("pmod(xxhash64(d), parts)"))
    rows = rows.join(classes.select(F.col("id").alias("d"), "n", "sketch"), "d")
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    rows = rows.select(F.expr("xxhash64(block, least(part, other), greatest(part, other))").alias("tile"), F.expr("int(part > other)").alias("side"), "d", "c", "n", "sketch")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        tile, side, n = (rows[c].to_numpy() for c in ("tile", "side", "n"))
        component = rows["c"].combine_chunks().dictionary_encode().indices.to_numpy()
        sketch = rows["sketch"].combine_chunks()
        flat, first = sketch.values.to_numpy().view(np.uint64), sketch.offsets.to_numpy().astype(np.int64)
        found = []
        for x, y in pairs_within(tile, side):
            other = component[x] != component[y]
            x, y = x[other], y[other]
            ok = linkable(x, y, n, flat, first[:-1], np.diff(first), percent)
            found.append((x[ok], y[ok]))
        d = rows["d"].combine_chunks()
        return pa.RecordBatch.from_arrays([d.take(pa.array(np.concatenate(at))) for at in zip(*found)], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            tile = batch.column(0).to_numpy()
            if len(tile) == 0:
                continue
            cut = int(np.argmax(tile == tile[-1]))  # the last tile may go on in the next batch
            if held and (cut or tile[0] != held[-1].column(0)[-1].as_py()):
                yield compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield compare(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield compare(pa.Table.from_batches(held))

    found = rows.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(run, f"x {key_type}, y {key_type}")
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def of_keys(df: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, text).join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def verified_links(df: DataFrame, pairs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs of classes whose sets are similar enough, compared element by element."""
    pairs = settle(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id"))
    sets = settle(shingle_sets(of_keys(df, wanted, key, text), key, text, width).select("key", "shingles"), "sets")
    both = pairs.join(sets.select(F.col("key").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("key").alias("y"), F.col("shingles").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    joined = both.select(F.col("x").alias("a"), F.col("y").alias("b"), common.alias("i"), (F.size("sx") + F.size("sy") - common).alias("u"))
    return settle(joined.where(f"100 * i >= {percent} * u").distinct(), "verified")
