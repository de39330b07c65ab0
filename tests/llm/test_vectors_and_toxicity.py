"""Vector codes, whitening and toxicity against plain Python, with awkward rows."""

from __future__ import annotations

import hashlib
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from compare import connect, differences

from wardbook.llm import whitening
from wardbook.llm.queries import LLM_ORACLE_SQL, LLM_QUERIES
from wardbook.llm.toxicity import Features, fit_toxicity, labelled_sample, score_toxicity, train
from wardbook.llm.vector_codes import EntryMasks, compress_vectors
from wardbook.llm.whitening import refine, whiten

# Columns named like the operators' own.
SCHEMA = "vec_id bigint, embedding array<double>, label int, x string, key string, other_0 int, error string, n int"


def table(spark, vectors, labels=None):
    labels = labels or [i % 3 if i % 7 else None for i in range(len(vectors))]
    rows = [(i, v if v is None else [None if c is None else float(c) for c in v], label, "x", "k", 1, "e", 2) for i, (v, label) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    spread = (rng.normal(size=(300, 8)) * [4, 3, 2.5, 2, 1, 0.5, 0.2, 0.1]).tolist()
    bad = [None, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [float("inf")] + [0.0] * 7, [1.0] * 3, [], [1e300] + [0.0] * 7]
    return spread + bad + spread[:5] * 20 + [[0.0] * 8, [-0.0] * 8, [-3.0] * 8]


def good(vectors, largest=65_536.0):
    return [i for i, v in enumerate(vectors) if v is not None and len(v) == 8 and all(c is not None and abs(c) < largest for c in v)]


def codes_by_hand(x, labels, parts, entries, rounds):
    d = x.shape[1] // parts
    books = [x[:entries, p * d : p * d + d].copy() for p in range(parts)]

    def nearest(p):
        distance = ((x[:, None, p * d : p * d + d] - books[p][None]) ** 2).sum(2)
        return distance.argmin(1), distance.min(1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = nearest(p)
            for e in set(at.tolist()):
                mine = x[at == e, p * d : p * d + d]
                books[p][e] = [sum(column) // len(mine) for column in mine.T.tolist()]
    found = [nearest(p) for p in range(parts)]
    error = sum(distance for _, distance in found)
    code = ["".join(f"{at[i]:02x}" for at, _ in found) for i in range(len(x))]
    sums = {label: sum(e for e, other in zip(error.tolist(), labels) if other == label) for label in labels}
    numbers = ",".join(str(n) for b in books for n in b.ravel().tolist())
    return code, error.tolist(), [sums[label] for label in labels], hashlib.sha256(numbers.encode()).hexdigest()


@pytest.mark.parametrize("entries", [256, 9, 1])
def test_codes_equal_exhaustive_search(spark, vectors, entries):
    df = table(spark, vectors)
    coded, books = compress_vectors(df, entries=entries)
    labels = {r["vec_id"]: r["label"] for r in df.collect()}
    kept = good(vectors)
    x = np.floor(1024 * np.array([vectors[i] for i in kept])).astype(np.int64)
    code, error, label_error, sha = codes_by_hand(x, [labels[i] for i in kept], 4, entries, 4)
    got = sorted(map(tuple, coded.collect()))
    assert got == [tuple(r) for r in zip(kept, code, error, label_error)]
    assert books.sha256 == sha


def test_nearest_entry_with_ties_and_far_vectors():
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(-3, 3, (100, 3)), rng.integers(-3, 3, (100, 3))])
    x = np.concatenate([rng.integers(-5, 5, (500, 3)), rng.integers(-60_000, 60_000, (200, 3))])
    at, squared = EntryMasks(entries).nearest(x)
    distance = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (at == distance.argmin(1)).all() and (squared == distance.min(1)).all()


def test_codes_of_repeated_keys_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 0), (1, [1.0, 2.0, 3.0, 4.0], 0), (None, [0.5] * 4, None), (None, [0.5] * 4, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = compress_vectors(df)[0].collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["label_error"]) for r in got) == [(0, "02020202", 0)] * 2 + [(1, "00000000", 0)] * 2
    assert compress_vectors(df.limit(0))[0].collect() == []
    assert whiten(df.limit(0))[0].collect() == []


def test_registered_codes_equal_sql(spark, sf_dir):
    assert differences(LLM_QUERIES["op11_vector_codes"](spark, sf_dir), connect(sf_dir), LLM_ORACLE_SQL["op11_vector_codes"]) == []


def covariance(x):
    """Exact covariance of whole vectors, as fractions."""
    n, d = x.shape
    s = [int(c) for c in x.sum(0)]
    rows = [[n * int(c) - t for c, t in zip(r, s)] for r in x]
    return [[Fraction(sum(r[i] * r[j] for r in rows), n**3) for j in range(d)] for i in range(d)]


def test_whitening(spark, vectors):
    kept = good(vectors, 2.0**40)
    x = np.floor(256 * np.array([vectors[i] for i in kept])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    out, model = whiten(table(spark, vectors))
    got = sorted(map(tuple, out.collect()))
    assert [r[:2] for r in got] == [(i, c) for i in kept for c in range(1, 5)]
    assert {r[2] for r in got} == {n}
    assert [r[3] for r in got[::4]] == ((n * x - s) ** 2).sum(1).tolist()
    v = covariance(fit)
    for c in range(4):
        u = model.vectors[:, c]
        # Residual of the eigenvector in exact arithmetic.
        ur = [Fraction(t) for t in u.tolist()]
        e = Fraction(float(model.values[c]))
        rest = [abs(sum(a * b for a, b in zip(row, ur)) - e * t) for row, t in zip(v, ur)]
        assert max(rest) / Fraction(model.values[0]) < Fraction(1, 10**14)
        assert abs(sum(t * t for t in ur) - 1) < Fraction(1, 10**14)
        w = (x - s / n) @ u / np.sqrt(model.values[c])
        assert np.abs(w - [r[4] for r in got[c::4]]).max() < 1e-10
        assert [r[5] for r in got[c::4]] == pytest.approx([float(e / sum(v[i][i] for i in range(8)))] * len(kept), rel=1e-12)
    assert all(r[6] < 1e-12 for r in got)


def test_refinement_separates_near_eigenvalues():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = np.array([1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-12, 0.3, 0.2, 0.2, 0.1, 1e-6, 1e-7, 0], np.longdouble)
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q + q @ (np.eye(12) - q.T @ q) / 2
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    _, start = np.linalg.eigh(a.astype(np.float32))
    found, x = refine(a, start.astype(np.longdouble))
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(12)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-17
    for simple in (0, 1, 2, 3, 4, 5):
        assert abs(abs(x[:, simple] @ q[:, simple]) - 1) < 1e-10


def test_whitening_without_variance_and_with_equal_eigenvalues(spark):
    corners = [[s * 2.0 if i == d else 0.0 for i in range(4)] for d in range(4) for s in (1, -1)]
    rows = whiten(table(spark, corners * 3))[0].collect()
    assert len(rows) == 96 and all(r["identity_error"] < 1e-12 and r["explained"] == pytest.approx(0.25) for r in rows)
    flat = whiten(table(spark, [[1.0, 2.0], [1.0, 2.0]]))[0].collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in flat] == [(c, None, None, None, 0) for c in (1, 2)] * 2
    line = whiten(table(spark, [[0.0, 1.0], [4.0, 1.0]]))[0].orderBy("vec_id", "component").collect()
    assert [abs(r["whitened"]) if r["whitened"] is not None else None for r in line] == [pytest.approx(1), None] * 2
    assert [r["explained"] for r in line] == [1.0, 0.0] * 2


def test_large_components_are_summed_exactly(spark):
    big = [[2.0**39, 1.0], [-(2.0**39), 3.0], [5.0, -(2.0**38)]]
    out, model = whiten(table(spark, big))
    x = [[int(256 * c) for c in v] for v in big]
    assert model.sums == [sum(c) for c in zip(*x)]
    v = covariance(np.array(x, object))
    assert model.trace == pytest.approx(float(v[0][0] + v[1][1]), rel=1e-15)
    assert {r["deviation"] for r in out.collect()} == {None}  # beyond a long
    assert whitening._products(np.array([0, 0]))(np.array(x))[0] == sum(r[0] ** 2 for r in x)


# --- toxicity ---

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, y int, id string, shard int, score double, cell int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    bad = ["vileness", "rotter", "blockhead"]
    rows, labels = [], []
    for i in range(1_500):
        words = rng.choice(plain, rng.integers(5, 60)).tolist()
        toxic = int(rng.random() < 0.2)
        if toxic:
            for w in rng.choice(bad, 2):
                words.insert(int(rng.integers(0, len(words))), str(w).upper() if i % 2 else str(w))
        rows.append((i, " ".join(words), "en", "s", 0, 1 - toxic, "i", 1, 0.5, 3))
        labels.append((i, 1, toxic))
    odd = [None, "", " \n", "!!! 12", "vileness " * 40_000, "ROTTER rotter", "日本 straße"]
    rows += [(2_000 + i, t, "en", "s", 0, 0, "i", 1, 0.5, 3) for i, t in enumerate(odd)] + [(None, "blockhead", "en", "s", 0, 0, "i", 1, 0.5, 3), rows[0], rows[0]]
    labels += [(None, 0, 1), (5, 1, None), (7, 1, 2), labels[0], (9_999, 0, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(6).cache(), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").cache()


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in range(1_500) if crc32(str(i).encode()) % 4 == 2}
    right = [r["predicted"] == truth[r["doc_id"]] for r in held]
    assert len(right) > 300 and sum(right) > 0.99 * len(right)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[2_000] == by_id[2_001] == by_id[2_002] < 0.3
    assert by_id[2_004] > 0.3 and by_id[2_005] > 0.3 and by_id[None] > 0.3
    assert not next(r["held_out"] for r in got if r["doc_id"] is None)


def test_held_out_labels_do_not_matter(labelled):
    docs, labels = labelled
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    first, second = (sorted((r["doc_id"] or -1, r["score"]) for r in score_toxicity(docs, t).collect()) for t in (labels, turned))
    assert first == second


def test_shards_partitions_and_sample(spark, labelled):
    docs, labels = labelled
    one = fit_toxicity(docs, labels, shard_rows=300)
    two = fit_toxicity(docs.repartition(13), labels.repartition(3), shard_rows=300)
    assert one.places.tolist() == two.places.tolist() and one.weights.tolist() == two.weights.tolist()
    sample = labelled_sample(labels, "doc_id", "toxic", 200)
    assert 100 < sample.count() <= 200
    assert labelled_sample(labels, "doc_id", "toxic", 10**6).count() == 1_501


def test_regression_is_sparse_and_skip_grams_matter():
    make = Features()
    rng = np.random.default_rng(4)
    plain = [f"p{chr(97 + i)}" for i in range(20)]
    texts, y = [], []
    for i in range(800):
        words = rng.choice(plain, 12).tolist()
        # Both words are everywhere; only one between them makes the label.
        words[3], words[5 if i % 2 else 9] = "alpha", "omega"
        texts.append(" ".join(words)), y.append(i % 2)
    used, weights = train([make.of(t) for t in texts[:600]], np.array(y[:600]), 0.0)
    table_ = np.zeros((1 << make.bits) + 1)
    table_[used] = weights
    assert len(used) < 50
    assert all((table_[make.of(t)].sum() + table_[-1] > 0) == bool(label) for t, label in zip(texts[600:], y[600:]))


def test_toxicity_of_empty_tables(spark, labelled):
    docs, labels = labelled
    assert score_toxicity(docs.limit(0), labels).collect() == []
    scores = {r["score"] for r in score_toxicity(docs, labels.limit(0)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.3
