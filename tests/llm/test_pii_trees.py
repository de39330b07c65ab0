"""Spans that the boosted trees add to those of the rules."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from wardbook.llm.pii import HELD_EXAMPLES, HELD_TEXTS, altered, base_spans, example_batches, examples, find_pii, fit_pii, luhn, proposals

SCHEMA = "doc_id bigint, text string, base string, spans string, of bigint, label int"


def card(rng: random.Random) -> str:
    digits = "".join(rng.choices("0123456789", k=15))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def person(rng: random.Random) -> dict[str, str]:
    c = card(rng)
    return {
        "email": "".join(rng.choices("abcdefgh", k=6)) + "@" + "".join(rng.choices("klmnop", k=5)) + ".example.com",
        "ip": ".".join(str(rng.randrange(10, 256)) for _ in range(4)),
        "card": " ".join(c[i : i + 4] for i in range(0, 16, 4)),
        "phone": f"+{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}",
    }


SAYS = {"email": "write to {} please", "ip": "seen from host {} today", "card": "paid by card {} then", "phone": "call tel {} now"}


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(400):
        who = person(rng)
        texts.append(". ".join(SAYS[k].format(v) for k, v in who.items()))
        texts.append(f"order {rng.randrange(10**9, 10**12)} of part 12-{rng.randrange(1000, 9999)}-{rng.randrange(100, 999)}, batch {rng.randrange(10**13, 10**16)} and 300.{rng.randrange(256, 999)}.1.7")
    texts += [None, "", "x" * 300_000 + " a@b.cd " + "9" * 50_000, texts[0], texts[0], "a(at)b" * 5_000, "@" * 2_000]
    df = spark.createDataFrame([(i, t, "b", "s", 1, 0) for i, t in enumerate(texts)], SCHEMA)
    return df.repartition(5), texts


def test_trees_add_spans_of_each_kind(spark, fitted):
    df, _ = fitted
    models = fit_pii(df)
    rng = random.Random(12)
    expected, rows = {}, []
    for i in range(160):
        kind = ("email", "ip", "card", "phone")[i % 4]
        other = altered(("email", "ip", "card", "phone").index(kind), person(rng)[kind], i // 4)
        text = SAYS[kind].format(other)
        if not base_spans(text):
            expected[i] = (kind, text.index(other), text.index(other) + len(other))
        rows.append((i, text, "b", "s", 1, 0))
    plain = [(1_000 + i, f"order {rng.randrange(10**9, 10**12)} of part 12-{rng.randrange(1000, 9999)}-{rng.randrange(100, 999)}, sum {rng.randrange(10**6, 10**8)}", "b", "s", 1, 0) for i in range(200)]
    got = {r["doc_id"]: r for r in find_pii(spark.createDataFrame(rows + plain, SCHEMA), models).collect()}
    caught = {kind: [any(tuple(s) == e for s in got[i]["spans"]) for i, e in expected.items() if e[0] == kind] for kind in SAYS}
    assert all(len(c) >= 10 and sum(c) >= 0.8 * len(c) for c in caught.values()), {k: (sum(c), len(c)) for k, c in caught.items()}
    # An order number may pass the rules themselves; what counts is what the trees add.
    assert sum(len(got[1_000 + i]["spans"]) > len(got[1_000 + i]["base"]) for i in range(200)) <= 4


def test_fit_depends_on_no_partitions_and_takes_long_texts(spark, fitted):
    df, texts = fitted
    first, second = (fit_pii(t, max_spans=300) for t in (df, df.repartition(2)))
    assert [(m.trees, m.threshold) for m in first] == [(m.trees, m.threshold) for m in second]
    assert any(k == 0 and y == 1 for k, y, _ in examples(texts[802]))  # behind 300,000 characters
    assert len(proposals("1234567 " + "5" * 40_000)) == 3
    assert all(not m.trees for m in fit_pii(df.limit(0)))


def test_base_spans_stay(fitted):
    df, texts = fitted
    for r in find_pii(df, fit_pii(df)).collect():
        assert [tuple(s) for s in r["base"]] == [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in base_spans(texts[r["doc_id"]] or "")]
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}


def test_examples_are_passed_on_in_bounded_batches():
    texts = ["call +49 170 555 1234 or 10.0.0.1 or a@b.example.com"] * 1_500 + [None, ""] + ["10.0.0.1 and " * 3_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["of", "t"])
    made = list(example_batches(iter([batch])))
    assert max(b.num_rows for b in made) <= HELD_EXAMPLES < sum(b.num_rows for b in made)
    found = [row for b in made for row in zip(*(c.to_pylist() for c in b.columns))]
    assert found == [(i, n, k, y, [float(v) for v in x]) for i, t in enumerate(texts) for n, (k, y, x) in enumerate(examples(t or ""))]


def test_spans_of_more_texts_than_a_task_holds(spark):
    rows = [(i, f"from 10.0.{i // 256}.{i % 256} on", "kept") for i in range(3 * HELD_TEXTS + 7)]
    found = find_pii(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1), []).collect()
    assert [(r.doc_id, r.text, r.lang, [(s.kind, s.start, s.end) for s in r.base]) for r in found] == [(i, t, g, [("ip", 5, len(t) - 3)]) for i, t, g in rows]
