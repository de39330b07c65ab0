"""Operator 12: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.session import settle

WORDS = re.compile(r"[^\W\d_]+")
HASH_BITS = 20
ODD = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
CACHE_WORDS = 400_000  # hashes of words a worker keeps; a full cache starts anew
SAMPLE_CELLS = 65_536

# Step size, its smoothing, and the two penalties of the regression: strict ones
# choose the features, the second run weighs the chosen ones with little shrinkage.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 40.0, 1.0
REFIT_ALPHA, REFIT_L1 = 1.0, 3.0
EPOCHS = 10


class Features:
    """Hashed features of texts: words, pairs of neighbours, and pairs with one or two words between."""

    def __init__(self, bits: int = HASH_BITS, longest_skip: int = 2):
        self.bits, self.longest_skip = bits, longest_skip
        self.words: dict[str, int] = {}

    def word_hashes(self, text: str) -> np.ndarray:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known, out = self.words, []
        for w in WORDS.findall(text.lower()):
            h = known.get(w)
            if h is None:
                raw = w.encode("utf-8", "surrogatepass")
                h = known[w] = (crc32(raw) << 32 | crc32(raw[::-1])) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return np.array(out, np.uint64)

    def places(self, words: np.ndarray) -> np.ndarray:
        """A place below 2^bits for each occurrence of a feature."""
        shift = np.uint64(64 - self.bits)
        found = [(words * ODD[0]) >> shift]
        for step in range(1, self.longest_skip + 2):
            # The distance is part of the hash, so a pair with a gap is another feature.
            pair = words[:-step] * ODD[1] ^ (words[step:] + np.uint64(step)) * ODD[2]
            found.append(((pair ^ pair >> np.uint64(29)) * ODD[0]) >> shift)
        return np.concatenate(found).astype(np.int64)

    def of(self, text: str | None) -> np.ndarray:
        """The distinct features of a text, in order."""
        return np.unique(self.places(self.word_hashes(text or "")))


def follow(docs: list[np.ndarray], labels: np.ndarray, base: float, alpha: float, l1: float, bits: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights different from zero after EPOCHS passes of FTRL-proximal in random order.

    Every coordinate has its own rate, which falls with the squared gradients
    it has seen, and stays at zero until its gradients add up to more than ``l1``.
    The place 2^bits is the intercept: every text has it, it has no L1, and it starts from ``base``.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    strict = np.full(len(z), l1)
    strict[-1] = 0
    order = np.random.default_rng(seed)

    def weight(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= strict[at], 0.0, -(z[at] - np.sign(z[at]) * strict[at]) / ((BETA + np.sqrt(n[at])) / alpha + L2))

    for _ in range(EPOCHS):
        for d in order.permutation(len(docs)):
            at = docs[d]
            w = weight(at)
            gradient = 1 / (1 + np.exp(-np.clip(base + w.sum(), -35, 35))) - labels[d]
            seen = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(seen) - np.sqrt(n[at])) / alpha * w
            n[at] = seen
    used = np.flatnonzero(np.abs(z) > strict)
    return used, weight(used)


def train(docs: list[np.ndarray], labels: np.ndarray, base: float, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features chosen under a strict L1, weighed by a second run over them alone; ``base`` is the log-odds of label 1."""
    docs = [np.append(d, 1 << bits) for d in docs]
    chosen = np.zeros((1 << bits) + 1, bool)
    chosen[follow(docs, labels, base, ALPHA, L1, bits)[0]] = True
    chosen[-1] = True
    return follow([d[chosen[d]] for d in docs], labels, base, REFIT_ALPHA, REFIT_L1, bits)


@dataclass
class ToxicityModel:
    """Log-odds of label 1 for a text without features, and the sparse weights: 2^bits at most, 12 bytes each."""

    base: float
    places: np.ndarray
    weights: np.ndarray
    bits: int = HASH_BITS

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with a column ``out``: the probability of label 1 for the whole text."""
        base, places, weights, bits = self.base, self.places, self.weights, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(1 << bits, np.float32)
            table[places] = weights
            used = table != 0
            features = Features(bits)
            for batch in batches:
                total = np.full(batch.num_rows, base)
                for i, t in enumerate(batch.column(text).to_pylist()):
                    if t:
                        at = features.places(features.word_hashes(t))
                        total[i] += table[np.unique(at[used[at]])].sum(dtype=np.float64)
                score = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
                yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, out])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(run, f"{fields}, `{out}` double")


def labelled_sample(labels: DataFrame, key: str, label: str, max_rows: int) -> DataFrame:
    """(key, y) for at most ``max_rows`` labelled keys, the same ones whatever the partitions.

    Keys are dealt by hash into SAMPLE_CELLS cells, and whole cells are taken in order as long as
    they fit, so only a count per cell is gathered. A key with both labels counts as 1.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    rows = settle(rows.withColumn("cell", F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(SAMPLE_CELLS)).cast("int")), "labelled")
    counts = np.zeros(SAMPLE_CELLS, np.int64)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    cells = int(np.searchsorted(np.cumsum(counts), max_rows, "right"))
    return rows.where(F.col("cell") < cells).select("key", "y")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 40_000, shard_rows: int = 8_000, bits: int = HASH_BITS
) -> ToxicityModel:
    """Fit on the texts of at most ``max_rows`` labelled keys, chosen by hash.

    The list of chosen keys is bounded by that parameter and so broadcast: texts
    are not shuffled, but turned into hashed features where they are read. Every
    ``shard_rows`` texts, or part of that, make a shard dealt by the hash of key and text; each is
    fitted by one task and the weights are averaged. Keys without a text, and
    texts without a label, take no part; a null text is empty; copies of a row
    count as often as they stand there. Without rows of label 1 no feature has a weight.
    """
    chosen = settle(labelled_sample(labels, key, label, max_rows), "chosen-labels")
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    known = known.select("y", F.xxhash64(F.col("key").cast("string"), "text").alias("id"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(bits)
        for batch in batches:
            at = [make.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("id"), pa.array(at, pa.list_(pa.int64())).cast(pa.list_(pa.int32()))], names=["y", "id", "at"])

    made = settle(known.mapInArrow(features, "y int, id bigint, at array<int>"), "hashed-texts")
    n, ones = made.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = float(np.log((ones + 0.1) / (n - ones + 1)))
    if not ones or ones == n:
        return ToxicityModel(base, np.empty(0, np.int64), np.empty(0), bits)
    shards = -(-n // shard_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for batch in batches:
            for shard, y, row, at in zip(*(batch.column(c).to_pylist() for c in ("shard", "y", "id")), batch.column("at")):
                docs.setdefault(shard, []).append((row, y, at.values.to_numpy()))
        for shard in sorted(docs):
            rows = sorted(docs.pop(shard), key=lambda r: r[:2])
            used, weights = train([r[2] for r in rows], np.array([r[1] for r in rows]), base, bits)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(weights)], names=["place", "weight"])

    dealt = made.withColumn("shard", F.pmod("id", F.lit(shards)).cast("int")).repartition(int(shards), "shard")
    summed = dealt.mapInArrow(fit, "place int, weight double").groupBy("place").agg(F.sum("weight").alias("weight"))
    # Sums of doubles depend on their order; rounded ones do not.
    found = summed.select("place", F.round(F.col("weight") / int(shards), 9).alias("weight")).orderBy("place").toPandas()
    places, weights = found["place"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)
    feature = places < 1 << bits
    return ToxicityModel(base + float(weights[~feature].sum()), places[feature], weights[feature], bits)


def held_out(key: str):
    """True for keys whose crc32 as text leaves 2 when divided by 4; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", cut: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for every document.

    The model sees labels of keys that are not held out only, and of a document
    nothing but its text. Null and empty texts get the model's base rate. Every
    row of ``docs`` gives a row; other columns are left out. Empty tables are
    allowed: without labels every text gets the same low score.
    """
    model = fit_toxicity(docs, labels.where(~held_out(key)), key, text, label)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out(key).alias("held_out"))
    scored = model.score(slim, "text", "score")
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
