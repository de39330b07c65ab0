"""Operator 5: quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model counts word trigrams in Spark, one slice of middle words at a time.
Below the words lies a spelling model of characters, which gives words never
seen a probability of their own.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.session import release, settle

# Spelling reads characters as 128 classes, so its table has at most 2^21
# entries whatever the corpus: its size is bounded before it is broadcast.
CLASSES = 128
START = 0
SPACE = 32
FOLDS = 2
# Words are runs of other characters than white space (kind 1); in scripts without spaces (kind 2) each character is one.
KINDS = np.array([1 if chr(i).isspace() else 2 if 0x3040 <= i < 0x3100 or 0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xD7B0 else 0 for i in range(0xD7B1)], np.int8)
PART_WORDS = 64
USUAL_POINTS, USUAL_PLACES = 512, 64  # characters and places whose random numbers are held in a table
END_LOG_P = float(np.log(1e-3))  # what spelling gives the end of a text
# So many of the most frequent words are answered from a broadcast list; all others are looked up in their bucket.
HOT_WORDS = 100_000
# Trigrams are counted and looked up in so many slices by their middle word, and only one lies on disk at a time;
# small corpora take fewer, with at least SLICE_WORDS trusted words each.
SLICES = 6
SLICE_WORDS = 1_000_000
# Trusted words in a bucket, about: the least, and up to four times as many once a slice has so many buckets. A middle
# word with more than a bucket's is split by the word before it.
BUCKET_WORDS = 100_000
BUCKETS = 64
CHUNK_CHARS = 1_000_000  # characters, about, that are read together
PACKED_GRAMS = 300_000  # n-grams that a task packs together, or looks up at once: a row for each bucket, so there should be many a row
SCORES = ("perplexity", "lowest", "highest")
CUTS = ("low", "high", "part_low", "part_high")
BINS = 100  # cuts are set to a hundredth of the log score
SHRINK = 100


def fold_of(text: str) -> int:
    """The half a text belongs to, by its content: copies share it."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=1).digest()[0] % FOLDS


def spelling_counts(df: DataFrame, text: str) -> DataFrame:
    """(gram, n) over all texts for each fold, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FOLDS * CLASSES**3, np.int64)
        for c in chunks(batches, False):
            grams, begin = c.spelled()
            fold = np.repeat(c.fold, c.size - 3)
            total += np.bincount(grams + np.repeat(fold, np.diff(begin, append=len(grams))) * CLASSES**3, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    return df.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and more, from the numbers of types seen 1 to 4 times."""
    n1, n2, n3, n4 = (max(1, n or 0) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def smoothed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """One order of the interpolation: counts (context, next) and the probability of each next under the shorter context."""
    d = discounts(*(int((counts == k).sum()) for k in (1, 2, 3, 4)))[np.minimum(counts, 3)]
    total = counts.sum(-1, keepdims=True)
    freed = np.minimum(d, counts).sum(-1, keepdims=True)
    seen = np.maximum(total, 1)
    return np.where(total > 0, (np.maximum(counts - d, 0) + freed * lower) / seen, lower)


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Log probability of every trigram of classes, as float32."""
    c3 = counts.reshape(CLASSES, CLASSES, CLASSES)
    c2 = (c3 > 0).sum(0)  # in how many contexts a pair continues
    c1 = (c2 > 0).sum(0)
    p1 = smoothed(c1[None, :], np.full((1, CLASSES), 1 / CLASSES))
    p2 = smoothed(c2, p1)
    return np.log(smoothed(c3, p2[None, :, :])).astype(np.float32).ravel()


def _mixed(*ids: np.ndarray) -> np.ndarray:
    """One 64-bit id for each row of ids; the order and the number of ids count."""
    x = np.full(ids[0].shape, len(ids), np.uint64)
    for i in ids:
        x = (x ^ i) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


@functools.cache
def _character_ids() -> np.ndarray:
    """The random numbers of the usual characters at the usual places."""
    points, places = np.arange(USUAL_POINTS, dtype=np.uint64), np.arange(USUAL_PLACES, dtype=np.uint64)
    return _mixed(np.repeat(points[None], USUAL_PLACES, 0), np.repeat(places[:, None], USUAL_POINTS, 1)).ravel()


def character_ids(points: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random number for each character at its place."""
    usual = (points < USUAL_POINTS) & (place < USUAL_PLACES)
    if usual.all():
        return _character_ids()[place * USUAL_POINTS + points]
    out = _character_ids()[np.where(usual, place * USUAL_POINTS + points, 0)]
    rare = np.flatnonzero(~usual)
    out[rare] = _mixed(points[rare].astype(np.uint64), place[rare].astype(np.uint64))
    return out


class _Reader:
    """The spelling of words under one fold's model."""

    def __init__(self, spelling: np.ndarray):
        self.spelling = spelling

    def spell(self, words: list[str], fold: int) -> np.ndarray:
        return _Chunk([0], [" ".join(words)], [fold]).spell(self.spelling)


class _Chunk:
    """Many texts with words, read together: the ids ``s`` of their words between marks, and a slot for each part of each text."""

    def __init__(self, keys: list[int], texts: list[str], folds: list[int]):
        self.keys, self.fold = np.array(keys, np.int64), np.array(folds, np.int64)
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = KINDS[np.minimum(points, len(KINDS) - 1)]
        word = kind != 1
        cut = np.append(True, (kind[:-1] != 0) | (kind[1:] == 2))
        begin = np.flatnonzero(word & cut)
        self.length = np.flatnonzero(word & np.append(~word[1:] | cut[1:], True)) + 1 - begin
        self.points = points[word]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.size = np.diff(np.searchsorted(begin, ends), prepend=0) + 3
        self.end = np.cumsum(self.size)
        start = self.end - self.size
        self.s = np.empty(self.end[-1], np.uint64)
        self.is_word = np.ones(len(self.s), bool)
        for at, mark in ((start, self.fold), (start + 1, self.fold), (self.end - 1, FOLDS + self.fold)):
            self.s[at], self.is_word[at] = mark, False
        offset = np.cumsum(self.length) - self.length
        folds_of = np.repeat(self.fold, self.size - 3)
        place = np.arange(len(self.points)) * FOLDS - np.repeat(offset * FOLDS - folds_of, self.length)  # in the word, with its fold
        # An id is the sum of a random number for each character at its place.
        self.s[self.is_word] = _mixed(np.add.reduceat(character_ids(self.points, place), offset), self.length.astype(np.uint64))
        self.last = np.maximum(1, (self.size - 3) // PART_WORDS) - 1
        self.slot = np.cumsum(self.last + 1) - self.last - 1  # the first of each text

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Character trigrams of all words, each spelled from two start marks to a space, and where each word's begin."""
        begin = np.cumsum(self.length + 1) - self.length - 1
        c = np.full(len(self.points) + len(begin), SPACE, np.int64)
        at = np.arange(len(self.points)) + np.repeat(np.arange(len(begin)), self.length)
        c[at] = np.where(self.points < 128, np.where(self.points <= 32, SPACE, self.points), self.points % 31 + 1)
        before, before2 = np.concatenate([[START], c[:-1]]), np.concatenate([[START, START], c[:-2]])[: len(c)]
        before[begin] = START
        before2[begin] = START
        before2[begin + 1] = START
        return (before2 * CLASSES + before) * CLASSES + c, begin

    def spell(self, spelling: np.ndarray) -> np.ndarray:
        """Log probability of each word by its spelling, and of each end of a text, in their order."""
        grams, begin = self.spelled()
        fold = np.repeat(np.repeat(self.fold, self.size - 3), self.length + 1)
        out = np.full(len(self.s), END_LOG_P)
        out[self.is_word] = np.add.reduceat(spelling[fold, grams].astype(np.float64), begin)
        return out[self.behind(2)]

    def behind(self, marks: int) -> np.ndarray:
        """Where in ``s`` ids lie that have so many start marks before them."""
        found = np.ones(len(self.s), bool)
        for i in range(marks):
            found[self.end - self.size + i] = False
        return np.flatnonzero(found)

    def trigrams(self, chosen: int, slices: int) -> np.ndarray:
        """Where the trigrams begin whose middle word is in the slice."""
        mine = slice_of(self.s, slices) == chosen
        begins = np.append(mine[1:], False)
        begins[self.end - 1] = begins[self.end - 2] = False
        return np.flatnonzero(begins)

    def slots(self, at: np.ndarray, shift: int) -> np.ndarray:
        """The slot of the n-gram's last word, when it lies ``shift`` ids behind place ``at``."""
        text = np.searchsorted(self.end, at, "right")
        word = np.maximum(at - (self.end - self.size)[text] + shift - 2, 0)
        return self.slot[text] + np.minimum(word // PART_WORDS, self.last[text])

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The text's key and the part of each slot."""
        text = np.repeat(np.arange(len(self.keys)), self.last + 1)
        return self.keys[text], (np.arange(len(text)) - self.slot[text]).astype(np.int32)


def slice_of(ids: np.ndarray, slices: int) -> np.ndarray:
    return (_mixed(ids) % np.uint64(slices)).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], flip: bool) -> Iterator[_Chunk]:
    """Texts with words (last column, their key before it) by some ``CHUNK_CHARS``; ``flip`` reads them under the other fold's model."""
    keys, texts, folds, n = [], [], [], 0
    for batch in batches:
        column = batch.column(batch.num_columns - 1).to_pylist()
        for key, t in zip(batch.column(0).to_pylist() if batch.num_columns > 1 else [0] * len(column), column):
            if t and not t.isspace():
                keys.append(key)
                texts.append(t)
                folds.append(FOLDS - 1 - fold_of(t) if flip else fold_of(t))
                n += len(t)
                if n >= CHUNK_CHARS:
                    yield _Chunk(keys, texts, folds)
                    keys, texts, folds, n = [], [], [], 0
    if keys:
        yield _Chunk(keys, texts, folds)


# Many n-grams of one bucket travel as one row of packed arrays.
PACKED = {"bucket": pa.int64(), "kind": pa.int32(), "chunk": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}
PACKED_DDL = "bucket bigint, kind int, chunk bigint, a binary, b binary, c binary, d binary"
TRUSTED, PAIRS, WORDS, ASKED, ASKED_WORDS, SLOTS = range(6)


def pack(kind: int, bucket: np.ndarray, arrays: list[np.ndarray], chunk: int = 0) -> pa.RecordBatch:
    """One row for each bucket, with the arrays' items of that bucket in their order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 2**16 else bucket, kind="stable")  # short numbers are sorted by radix
    bucket, arrays = bucket[order], [x[order] for x in arrays]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    begin, end = np.append(0, cut), np.append(cut, len(bucket))
    if not len(bucket):
        begin = end = begin[:0]
    columns = [[x[i:j].tobytes() for i, j in zip(begin, end)] for x in arrays] + [[None] * len(begin)] * (4 - len(arrays))
    rows = [bucket[begin], np.full(len(begin), kind, np.int32), np.full(len(begin), chunk, np.int64), *columns]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, PACKED.values())], names=list(PACKED))


def packed(kind: int, made: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Buckets with their arrays, packed some ``PACKED_GRAMS`` items at a time."""
    held, n = [], 0
    for arrays in made:
        held.append(arrays)
        n += len(arrays[0])
        if n >= PACKED_GRAMS:
            bucket, *rest = (np.concatenate(x) for x in zip(*held))
            yield pack(kind, bucket, rest)
            held, n = [], 0
    if held:
        bucket, *rest = (np.concatenate(x) for x in zip(*held))
        yield pack(kind, bucket, rest)


def unpack(table: pa.Table, kind: int, *types) -> list[np.ndarray]:
    """The arrays of all rows of a kind, one after the other."""
    rows = table.filter(pc.equal(table["kind"], kind))
    return [np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in zip("abcd", types)]


def find(keys: np.ndarray, asked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each asked key among the sorted keys, or 0."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


def vocabulary(df: DataFrame, text: str, spelling) -> DataFrame:
    """Distinct words of each fold with end marks: id, fold, spelling and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, False):
            at = c.behind(2)
            word, first, n = np.unique(c.s[at], return_index=True, return_counts=True)
            fold = np.repeat(c.fold, c.size - 2)[first]
            columns = [word.view(np.int64), fold.astype(np.int32), c.spell(spelling.value)[first], n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "fold", "spell", "n"])

    made = df.select(text).mapInArrow(run, "word bigint, fold int, spell double, n bigint")
    return made.groupBy("word", "fold").agg(F.min("spell").alias("spell"), F.sum("n").alias("n"))


def _in_buckets(df: DataFrame, text: str, chosen: int, slices: int, buckets: int, run, schema: str) -> DataFrame:
    """Apply ``run`` to every bucket of pairs with their trusted trigrams (pair, trigram, middle and last word)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for c in chunks(batches, False):
            at = c.trigrams(chosen, slices)
            mid, word = c.s[at + 1], c.s[at + 2]
            pair = _mixed(mid, word)
            gram = _mixed(_mixed(c.s[at], mid), pair)
            yield (pair >> np.uint64(20)).astype(np.int64) % buckets, pair, gram, mid, word

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(TRUSTED, made(batches))

    def bucket(table: pa.Table) -> pa.Table:
        pair, gram, mid, word = unpack(table, TRUSTED, *[np.uint64] * 4)
        _, first, n3 = np.unique(gram, return_index=True, return_counts=True)
        _, at, n2 = np.unique(pair[first], return_index=True, return_counts=True)
        first = first[at]
        return run(n3, pair[first], mid[first], word[first], n2)

    return df.select(text).mapInArrow(deal, PACKED_DDL).groupBy("bucket").applyInArrow(bucket, schema)


def _table(**columns) -> pa.Table:
    return pa.table({n: x.view(np.int64) if x.dtype == np.uint64 else x for n, x in columns.items()})


def word_sums(df: DataFrame, text: str, chosen: int, slices: int, buckets: int) -> DataFrame:
    """For each word its pairs as last word, its trigrams and pairs of one, two and more trigrams as middle word.

    The rows of word null count the trigrams (order 3) and pairs (order 2) of 1 to 4.
    """

    def run(n3, pair, mid, word, n2) -> pa.Table:
        words, at = np.unique(np.concatenate([word, mid]), return_inverse=True)
        last, middle = at[: len(word)], at[len(word) :]
        sums = [np.bincount(last, minlength=len(words)), np.bincount(middle, n2, len(words))]
        sums += [np.bincount(middle, which, len(words)) for which in (n2 == 1, n2 == 2, n2 > 2)]
        seen = [[*(int((n == k).sum()) for k in (1, 2, 3, 4)), 0] for n in (n3, n2)]
        columns = [[None, None, *words.view(np.int64).tolist()], [3, 2, *[0] * len(words)]]
        columns += [[*k, *x.astype(np.int64).tolist()] for k, x in zip(zip(*seen), sums)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["word", "order", "n", "total", "ones", "twos", "more"])

    made = _in_buckets(df, text, chosen, slices, buckets, run, "word bigint, order bigint, n bigint, total bigint, ones bigint, twos bigint, more bigint")
    return made.groupBy("word", "order").agg(*[F.sum(c).alias(c) for c in ("n", "total", "ones", "twos", "more")])


def pair_counts(df: DataFrame, text: str, chosen: int, slices: int, buckets: int) -> DataFrame:
    """Distinct pairs of a slice: id, middle and last word, and in how many trigrams they end."""

    def run(n3, pair, mid, word, n2) -> pa.Table:
        return _table(pair=pair, mid=mid, word=word, n=n2.astype(np.int64))

    return _in_buckets(df, text, chosen, slices, buckets, run, "pair bigint, mid bigint, word bigint, n bigint")


def _discount(d: np.ndarray, n: str) -> str:
    return f"CASE {n} WHEN 1 THEN {float(d[1])!r}D WHEN 2 THEN {float(d[2])!r}D ELSE {float(d[3])!r}D END"


class QualityModel:
    """Trusted text with the values of its words and, per language, the perplexities between which a text is kept.

    With p(w) the probability under the shorter context and b the log share a
    context leaves to it, an n-gram seen adds log p - b - log p(w), a context
    seen adds b, and what was never seen adds nothing. So the log probability
    of a text is its spelling plus one value for each n-gram in it. A trigram,
    its context and its last pair share the middle word: their values are made
    and looked up one slice of middle words after the other, in buckets that
    hold the trusted trigrams and those asked for, so that neither the model
    nor the n-grams of all texts ever lie on disk as a whole.
    """

    def __init__(self, trusted: DataFrame | None = None, spelling=None):
        self.trusted, self.spelling, self.bounds, self.known = trusted, spelling, None, None
        if trusted is not None:
            self._fit()

    def _fit(self) -> None:
        spark, trusted = self.trusted.sparkSession, self.trusted
        vocab = settle(vocabulary(trusted, "text", self.spelling), "vocabulary")
        n = vocab.agg(F.sum("n")).first()[0]
        self.slices = max(1, min(SLICES, n // SLICE_WORDS))
        most = min(max(BUCKET_WORDS, n // self.slices // BUCKETS), 4 * BUCKET_WORDS)
        self.buckets = -(-n // self.slices // most)
        sums = [settle(word_sums(trusted, "text", k, self.slices, self.buckets), "word-sums") for k in range(self.slices)]
        every = functools.reduce(DataFrame.unionByName, sums)
        seen = {r["order"]: r for r in every.where("word IS NULL").groupBy("order").agg(*[F.sum(c).alias(c) for c in ("n", "total", "ones", "twos")]).collect()}
        self.d3, self.d2 = (discounts(*seen[o][1:]) for o in (3, 2))
        t1 = every.where("word IS NOT NULL").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "total", "ones", "twos", "more")])
        # The start mark is a middle word only, and not in the vocabulary.
        t1 = settle(t1.join(vocab.withColumnRenamed("n", "times"), "word", "left"), "words")
        release(*sums, vocab)
        d1 = discounts(*t1.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())
        t1 = t1.withColumn("d", F.expr(_discount(d1, "n")))
        totals = {r["fold"]: r for r in t1.where("n > 0").groupBy("fold").agg(F.sum("n").alias("total"), F.sum("d").alias("freed")).collect()}
        self.shares = [float(np.log(totals[f]["freed"] / totals[f]["total"])) if f in totals else 0.0 for f in range(FOLDS)]
        total = F.expr("CASE fold " + " ".join(f"WHEN {f} THEN {r['total']}D" for f, r in totals.items()) + " END")
        lower = F.col("spell") + F.expr("CASE fold " + " ".join(f"WHEN {f} THEN {self.shares[f]!r}D" for f in totals) + " END")
        one, two, more = (float(x) for x in self.d2[1:])
        freed = F.col("ones") * one + F.col("twos") * two + F.col("more") * more
        t1 = t1.withColumn("lower", lower).withColumn("lp1", F.when(F.col("n") > 0, F.log((F.col("n") - F.col("d")) / total + F.exp("lower"))))
        t1 = t1.withColumn("back", F.when(F.col("total") > 0, F.log(freed / F.col("total"))))
        value = F.coalesce(F.col("lp1") - F.col("lower"), F.lit(0.0)) + F.coalesce("back", F.lit(0.0))
        self.words = settle(t1.select("word", "total", "back", "lp1", value.alias("value"), F.coalesce("times", "total").alias("times")), "word-values")
        top = self.words.orderBy(F.desc("times"), "word").limit(HOT_WORDS).select("word", "value").toArrow()
        keys, values = top["word"].to_numpy().view(np.uint64), top["value"].to_numpy()
        order = np.argsort(keys)
        self.hot = spark.sparkContext.broadcast((keys[order], values[order]))
        # At most as many as there are buckets hold more than a bucket's words.
        wide = self.words.where(F.col("total") > most).select("word", "total").toArrow()
        keys, splits = wide["word"].to_numpy().view(np.uint64), -(-wide["total"].to_numpy() // most)
        order = np.argsort(keys)
        self.wide = spark.sparkContext.broadcast((keys[order], splits[order]))

    def _base(self, df: DataFrame, text: str) -> DataFrame:
        """For each text and part: spelling and hot words (x) with characters, and a first part without any for each text, as some have no words."""
        spelling, hot, shares = self.spelling, self.hot, self.shares

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = hot.value
            for c in chunks(batches, True):
                at, both = c.behind(2), c.behind(1)
                slot, n = c.slots(at, 0), c.slot[-1] + c.last[-1] + 1
                chars = np.ones(len(c.s))
                chars[c.is_word] += c.length
                x = np.bincount(slot, c.spell(spelling.value) + np.array(shares)[np.repeat(c.fold, c.size - 2)], n)
                x += np.bincount(c.slots(both, 0), find(keys, c.s[both], values), n)
                yield pa.RecordBatch.from_arrays([*map(pa.array, c.parts()), pa.array(x), pa.array(np.bincount(slot, chars[at], n).astype(np.int64))], names=["id", "part", "x", "chars"])

        known = df.select(F.xxhash64(text).alias("id"), text)
        wordless = known.select("id").distinct().select("id", F.lit(0).alias("part"), F.lit(0.0).alias("x"), F.lit(0).cast("bigint").alias("chars"))
        return known.mapInArrow(run, "id bigint, part int, x double, chars bigint").unionByName(wordless)

    def _slice(self, df: DataFrame, text: str, chosen: int) -> DataFrame:
        """For each text and part: the values of n-grams of one slice of middle words (x), hot words aside."""
        slices, buckets, wide, hot, d3 = self.slices, self.buckets, self.wide, self.hot, self.d3

        def bucket_of(mid: np.ndarray, split: np.ndarray | int = 0) -> np.ndarray:
            return ((_mixed(mid, np.broadcast_to(np.uint64(split), mid.shape)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)

        def place(mid: np.ndarray, ctx: np.ndarray) -> np.ndarray:
            """The bucket of a trigram: that of its middle word, or of the part of it that its context is in."""
            splits = np.maximum(find(wide.value[0], mid, wide.value[1]), 1).astype(np.uint64)
            return bucket_of(mid, _mixed(ctx) % splits)

        def trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[tuple[np.ndarray, ...]]:
                for c in chunks(batches, False):
                    at = c.trigrams(chosen, slices)
                    ctx, pair = _mixed(c.s[at], c.s[at + 1]), _mixed(c.s[at + 1], c.s[at + 2])
                    yield place(c.s[at + 1], ctx), ctx, pair

            return packed(TRUSTED, made())

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The n-grams of several chunks go together; the slots of each follow those of the ones before."""
            part, packs, keys = TaskContext.get().partitionId(), 0, hot.value[0]
            held, n, slots = {ASKED: [], ASKED_WORDS: [], SLOTS: []}, 0, 0

            def all_held() -> Iterator[pa.RecordBatch]:
                chunk = part << 32 | packs
                for kind, made in held.items():
                    bucket, *arrays = (np.concatenate(x) for x in zip(*made))
                    yield pack(kind, bucket if kind != SLOTS else bucket + chunk % buckets, arrays, chunk)
                    made.clear()

            for c in chunks(batches, True):
                at = c.trigrams(chosen, slices)
                ctx, pair = _mixed(c.s[at], c.s[at + 1]), _mixed(c.s[at + 1], c.s[at + 2])
                own, last = c.slots(at, 1), c.slots(at, 2)
                held[ASKED].append((place(c.s[at + 1], ctx), ctx, pair, ((own + slots) * 2 + (last - own)).astype(np.int32)))
                mine = slice_of(c.s, slices) == chosen
                mine[c.end - c.size] = False  # one of the two start marks is asked for
                words = np.flatnonzero(mine)
                words = words[keys[np.minimum(np.searchsorted(keys, c.s[words]), len(keys) - 1)] != c.s[words]]
                held[ASKED_WORDS].append((bucket_of(c.s[words]), c.s[words], (c.slots(words, 0) + slots).astype(np.int32)))
                ids, parts = c.parts()
                held[SLOTS].append((np.zeros(len(ids), np.int64), ids, parts))
                n, slots = n + len(at) + len(words), slots + len(ids)
                if n >= PACKED_GRAMS:
                    yield from all_held()
                    n, slots, packs = 0, 0, packs + 1
            if held[SLOTS]:
                yield from all_held()

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[tuple[np.ndarray, ...]]:
                for batch in batches:
                    pair, mid, lp2, value = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
                    mid = mid.view(np.uint64)
                    splits = np.maximum(find(wide.value[0], mid, wide.value[1]), 1).astype(np.int64)
                    each = np.repeat(np.arange(len(mid)), splits)
                    split = np.arange(len(each)) - (np.cumsum(splits) - splits)[each]
                    yield bucket_of(mid[each], split.astype(np.uint64)), *(x[each] for x in (pair.view(np.uint64), lp2, value))

            return packed(PAIRS, made())

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[tuple[np.ndarray, ...]]:
                for batch in batches:
                    word, value = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
                    word = word.view(np.uint64)
                    mine = slice_of(word, slices) == chosen
                    yield bucket_of(word[mine]), word[mine], value[mine]

            return packed(WORDS, made())

        def look_up(table: pa.Table) -> pa.Table:
            ctx, pair = unpack(table, TRUSTED, np.uint64, np.uint64)
            gram, first, n = np.unique(_mixed(ctx, pair), return_index=True, return_counts=True)
            d = d3[np.minimum(n, 3)]
            contexts, of = np.unique(ctx[first], return_inverse=True)
            total = np.bincount(of, n, len(contexts))
            back = np.log(np.bincount(of, d, len(contexts)) / total) if len(contexts) else np.zeros(0)
            known, lp2, pair_value = unpack(table, PAIRS, np.uint64, np.float64, np.float64)
            order = np.argsort(known)
            known, lp2, pair_value = known[order], lp2[order], pair_value[order]
            low = back[of] + find(known, pair[first], lp2)
            value = np.log((n - d) / total[of] + np.exp(low)) - low
            word, word_value = unpack(table, WORDS, np.uint64, np.float64)
            order = np.argsort(word)
            word, word_value = word[order], word_value[order]
            out = [(r["chunk"], r["a"], r["b"], None) for r in table.filter(pc.equal(table["kind"], SLOTS)).select(["chunk", "a", "b"]).to_pylist()]
            for kind in (ASKED, ASKED_WORDS):
                rows = table.filter(pc.equal(table["kind"], kind))
                size = pc.binary_length(rows["a"]).to_numpy() // 8
                done = np.append(0, np.cumsum(size))
                i = 0
                while i < len(size):
                    j = max(i + 1, int(np.searchsorted(done, done[i] + PACKED_GRAMS, "right")) - 1)
                    some, of = rows.slice(i, j - i), np.repeat(np.arange(j - i), size[i:j])
                    if kind == ASKED:
                        ctx, pair, slot = unpack(some, kind, np.uint64, np.uint64, np.int32)
                        x = np.concatenate([find(contexts, ctx, back), find(known, pair, pair_value) + find(gram, _mixed(ctx, pair), value)])
                        slot, of = np.concatenate([slot >> 1, (slot >> 1) + (slot & 1)]), np.concatenate([of, of])
                    else:
                        ids, slot = unpack(some, kind, np.uint64, np.int32)
                        x = find(word, ids, word_value)
                    key, x = (of << 32 | slot)[x != 0], x[x != 0]
                    key, at = np.unique(key, return_inverse=True)
                    x, slot = np.bincount(at, x, len(key)), (key & (2**32 - 1)).astype(np.int32)
                    cut = np.searchsorted(key, np.arange(j - i + 1) << 32)
                    out += [(k, None, slot[a:b].tobytes(), x[a:b].tobytes()) for k, a, b in zip(some["chunk"].to_pylist(), cut[:-1], cut[1:]) if a < b]
                    i = j
            return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["chunk", "ids", "slots", "x"])

        def add(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            ids, parts = next((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["slots"], np.int32)) for r in rows if r["ids"] is not None)
            total = np.zeros(len(ids))
            for r in rows:
                if r["x"] is not None:
                    total[np.frombuffer(r["slots"], np.int32)] += np.frombuffer(r["x"], np.float64)
            return pa.table({"id": ids, "part": parts, "x": total})

        counted = pair_counts(self.trusted, "text", chosen, slices, buckets)
        found = counted.join(self.words.select(F.col("word").alias("mid"), "total", "back"), "mid").join(self.words.select("word", "lp1"), "word")
        found = found.withColumn("low", F.col("back") + F.col("lp1")).withColumn("lp2", F.log((F.col("n") - F.expr(_discount(self.d2, "n"))) / F.col("total") + F.exp("low")))
        found = settle(found.select("pair", "mid", "lp2", (F.col("lp2") - F.col("low")).alias("value")), "pair-values")
        rows = df.select(F.xxhash64(text).alias("id"), text).mapInArrow(asked, PACKED_DDL).unionByName(self.trusted.select("text").mapInArrow(trusted, PACKED_DDL))
        rows = rows.unionByName(found.mapInArrow(pairs, PACKED_DDL)).unionByName(self.words.select("word", "value").mapInArrow(words, PACKED_DDL))
        sums = rows.groupBy("bucket").applyInArrow(look_up, "chunk bigint, ids binary, slots binary, x binary")
        out = settle(sums.groupBy("chunk").applyInArrow(add, "id bigint, part int, x double"), "slice-scores")
        release(found)
        return out

    def scores(self, df: DataFrame, text: str = "text") -> DataFrame:
        """(id, perplexity, lowest, highest) of each distinct text: per character, over all of it and over its parts."""
        written = [settle(self._base(df, text), "base-scores")]
        written += [self._slice(df, text, k) for k in range(self.slices)]
        each = [written[0], *[t.withColumn("chars", F.lit(0).cast("bigint")) for t in written[1:]]]
        # Copies of a text add to sums and characters alike, which leaves their quotient.
        parts = functools.reduce(DataFrame.unionByName, each).groupBy("id", "part").agg(F.sum("x").alias("x"), F.sum("chars").alias("chars"))
        one = F.exp(-F.col("x") / F.expr("nullif(chars, 0)"))
        whole = F.exp(-F.sum("x") / F.nullif(F.sum("chars"), F.lit(0)))
        out = settle(parts.groupBy("id").agg(whole.alias("perplexity"), F.min(one).alias("lowest"), F.max(one).alias("highest")), "scores")
        release(*written)
        return out

    def scored(self, df: DataFrame, text: str) -> DataFrame:
        """Append the three scores to every row; null without a model or without words."""
        kept = df.drop("_id", *SCORES)
        if self.trusted is None:
            return kept.withColumns({c: F.lit(None).cast("double") for c in SCORES})
        found = self.known
        new = kept.select(F.xxhash64(text).alias("id"), text).join(found, "id", "left_anti")
        if not new.isEmpty():
            found = found.unionByName(self.scores(new, text))
        return kept.withColumn("_id", F.xxhash64(text)).join(found.withColumnRenamed("id", "_id"), "_id", "left").drop("_id")

    def judge(self, df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
        """Append perplexity, low, high and kept to every row; kept looks at the parts of a text, too."""
        given = [c for c in df.columns if c not in ("perplexity", "low", "high", "kept")]
        scored = self.scored(df.select(*[F.col(c).alias(f"_in{i}") for i, c in enumerate(given)], F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang")), f"_in{given.index(text)}")
        back = [F.col(f"_in{i}").alias(c) for i, c in enumerate(given)]
        if self.bounds is None:
            return scored.select(*back, "perplexity", *[F.lit(None).cast("double").alias(c) for c in ("low", "high")], F.lit(True).alias("kept"))
        every = self.bounds.where("_lang IS NULL").first()
        out = scored.join(self.bounds.where("_lang IS NOT NULL"), "_lang", "left").withColumns({c: F.coalesce(c, F.lit(every[c])) for c in CUTS})
        inside = (F.col("perplexity").between(F.col("low"), F.col("high"))) & (F.col("lowest") >= F.col("part_low")) & (F.col("highest") <= F.col("part_high"))
        return out.select(*back, "perplexity", "low", "high", F.coalesce(inside, F.lit(True)).alias("kept"))


def best_cut(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, tail: float, slack: float) -> float:
    """The log score above which fewest labelled texts are judged wrongly, at most the ``tail`` quantile of good ones widened by ``slack``."""
    order = np.argsort(bins)
    b, g, x = bins[order], good[order], bad[order]
    above = g.sum() - np.cumsum(g)
    loosest = (b[np.argmax(above <= tail * g.sum())] + 1) / BINS + np.log(slack)
    wrong = above + np.cumsum(x)
    k = int(np.flatnonzero(wrong == wrong.min())[-1])
    return min(loosest, (b[k] + 1 + b[k + 1]) / 2 / BINS) if k + 1 < len(b) else loosest


def fit_cuts(scored: DataFrame, tail: float, slack: float) -> DataFrame:
    """(_lang, low, high, part_low, part_high) from scored rows with _lang and good; the row of null holds for all languages.

    The cuts of a language are averaged in logs with those of all, which weigh
    as much as ``SHRINK`` trusted texts. The cuts of parts are set on the rows
    that pass the cuts of whole texts.
    """

    def cut(held, low: str, high: str, scores: tuple[str, str]):
        found = {}
        for name, score, sign in ((low, scores[0], -1), (high, scores[1], 1)):
            one = held[held["score"] == score]
            bins = one["bin"].to_numpy() if sign > 0 else -(one["bin"].to_numpy() + 1)
            good, bad = (np.where(one["good"] == q, one["n"], 0) for q in (True, False))
            found[name] = sign * best_cut(bins, good, bad, tail, slack)
        return found, int(held[(held["score"] == scores[0]) & held["good"]]["n"].sum())

    def step(rows: DataFrame, low: str, high: str, scores: tuple[str, str]) -> DataFrame:
        parts = [rows.select("_lang", "good", F.lit(c).alias("score"), F.floor(F.log(c) * BINS).cast("bigint").alias("bin")) for c in dict.fromkeys(scores)]
        made = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        counted = settle(made.groupBy("_lang", "good", "score", "bin").agg(F.count("*").alias("n")), "score-histogram")
        overall = counted.groupBy("good", "score", "bin").agg(F.sum("n").alias("n")).toPandas()  # as many rows as there are bins
        every, _ = cut(overall, low, high, scores)

        def per_lang(held):
            own, n = cut(held, low, high, scores) if held["good"].any() else (every, 0)
            mixed = {c: float(np.exp((n * own[c] + SHRINK * every[c]) / (n + SHRINK))) for c in every}
            return held.iloc[:1][["_lang"]].assign(**mixed)

        out = counted.groupBy("_lang").applyInPandas(per_lang, f"_lang string, {low} double, {high} double")
        return settle(out.unionByName(rows.sparkSession.createDataFrame([(None, *map(float, np.exp([every[low], every[high]])))], out.schema)), "cuts")

    whole = step(scored, "low", "high", ("perplexity", "perplexity"))
    passed = scored.join(whole, "_lang").where("perplexity BETWEEN low AND high").drop("low", "high")
    parts = step(passed, "part_low", "part_high", ("lowest", "highest"))
    same = whole["_lang"].eqNullSafe(parts["_lang"])
    every = parts.where("_lang IS NULL").first()
    out = whole.join(parts, same, "left").select(whole["_lang"], "low", "high", *[F.coalesce(c, F.lit(every[c])).alias(c) for c in CUTS[2:]])
    return settle(out, "bounds")


def fit_quality(
    df: DataFrame,
    trusted_keys: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    tail: float = 0.002,
    slack: float = 1.1,
    bad_keys: DataFrame | None = None,
) -> QualityModel:
    """Train on every text whose key is trusted, and set the cuts per language on all labelled texts.

    Texts are dealt into two halves by their content, and each half trains a
    model by which the other half is scored, so no text is judged by a model
    that has seen it and all labelled texts are held out. Both ends of the
    scale are cut, for the whole text and for its parts of ``PART_WORDS``
    words, where fewest texts of ``trusted_keys`` and ``bad_keys`` are judged
    wrongly. No cut is looser than the ``tail`` and 1 - ``tail`` quantiles of
    the trusted texts, widened by the factor ``slack``; without ``bad_keys``
    these are the cuts. Languages with few trusted texts lean on all languages
    together, and those without take theirs. Null keys are never trusted, null
    and empty texts train nothing and are kept, and without trusted text
    everything is kept. Repeated rows count each.
    """
    lang_of = F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang")

    def listed(keys: DataFrame) -> DataFrame:
        return df.select(key, text, lang).join(keys.select(F.col(key)).distinct(), key, "left_semi").select(F.col(text).alias("text"), lang_of)

    trusted = settle(listed(trusted_keys), "trusted")
    counts = np.zeros(FOLDS * CLASSES**3, np.int64)
    table = spelling_counts(trusted, "text").toArrow()  # at most FOLDS * CLASSES ** 3 rows
    counts[table["gram"].to_numpy()] = table["n"].to_numpy()
    if not counts.any():
        return QualityModel()
    spelling = df.sparkSession.sparkContext.broadcast(np.stack([kneser_ney(c) for c in counts.reshape(FOLDS, -1)]))  # 16 MB
    model = QualityModel(trusted, spelling)
    model.known = model.scores(df, text)  # all texts at once, as those labelled and those to judge are mostly the same
    labelled = trusted.withColumn("good", F.lit(True))
    if bad_keys is not None:
        labelled = labelled.unionByName(listed(bad_keys).withColumn("good", F.lit(False)))
    scored = model.scored(labelled, "text").where("perplexity IS NOT NULL").select("_lang", "good", *SCORES)
    model.bounds = fit_cuts(settle(scored, "label-scores"), tail, slack)
    return model
