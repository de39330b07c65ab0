"""Every training-data operator against plain Python on a small table with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardbook.llm.decontaminate import decontaminate
from wardbook.llm.embeddings import embedding_links
from wardbook.llm.html_text import extract_text
from wardbook.llm.jaccard import jaccard_groups
from wardbook.llm.packing import pack_documents
from wardbook.llm.pii import base_spans, find_pii, fit_pii, redact
from wardbook.llm.quality import fit_quality
from wardbook.llm.repeats import cut_repeats
from wardbook.llm.sharding import shard_documents
from wardbook.llm.token_count import count_tokens

# Columns named like the operators' own, which must not get in their way.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, node int, n string, base string, d string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(40, 120)) for _ in range(12)]
    near = [re.sub(r"\S+$", "changed", t) for t in base[:4]]
    passage = sentence(rng, 60)
    shared = [f"{sentence(rng, 20)} {passage} {sentence(rng, 20)}" for _ in range(3)]
    odd = [None, "", " \n\t ", "One", "two Words", "é" * 150, "ab" * 300, base[0], base[0], sentence(rng, 6_000), "<|endoftext|> x", "日本 ﬁ   Straße"]
    personal = ["mail me at joe.b@mail7.example.com or +1 (555) 123-4567", "host 10.1.2.3 not 10.1.2.300, card 4111 1111 1111 1111, no 4111 1111 1111 1112"]
    return base + near + shared + odd + personal


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", 0, "x", "x", 1, "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_shards(docs, texts):
    got = rows_of(shard_documents(docs, shards=4))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["size"] == len((t or "").encode()) + 1
        assert got[i]["text_crc32"] == zlib.crc32((t or "").encode())
    for s in {r["shard"] for r in got.values()}:
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join(texts[0].split()[3:20])), (2, "two words"), (3, None), (4, ""), (5, " ".join(texts[17].split()[25:40]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = rows_of(decontaminate(docs, bench))
    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for gram, names in windows.items():
            for k in range(len(w) - len(gram) + 1):
                if tuple(w[k : k + len(gram)]) == gram:
                    hit.update(range(k, k + len(gram)))
                    found |= names
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found))
    assert any(r["contaminated"] for r in got.values())


def test_packing(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pieces = pack_documents(docs, path).collect()
    total = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine[:-1]]))
        assert sum(r["length"] for r in mine) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine)
        total += len(ids)
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by) <= -(-total // 2048) + 1


def test_token_counts(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = rows_of(count_tokens(docs, path))
    assert {i: got[i]["n_tokens"] for i in got} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def smallest_reachable(ids, linked):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard_groups(docs, texts):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = smallest_reachable(range(len(sets)), linked)
    got = rows_of(jaccard_groups(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert len(set(label.values())) < len(sets)


def test_quality(spark, docs, texts):
    junk = spark.createDataFrame([(900, "%$#@! " * 50 + "QQ##", "en"), (901, None, None), (902, "", "xx")], "doc_id bigint, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(junk)
    trusted = spark.createDataFrame([(i,) for i in range(12)] + [(None,)], "doc_id bigint")
    got = rows_of(fit_quality(every, trusted).judge(every))
    assert len(got) == len(texts) + 3
    assert all(got[i]["kept"] for i in range(12)) and not got[900]["kept"] and got[901]["kept"] and got[902]["kept"]
    untrained = fit_quality(every, trusted.where("doc_id < 0")).judge(every)
    assert untrained.where("kept").count() == len(got)


def test_pii(docs, texts):
    found = find_pii(docs, fit_pii(docs))
    got = rows_of(found)
    last = len(texts) - 1
    assert {texts[last - 1][s["start"] : s["end"]] for s in got[last - 1]["base"]} == {"joe.b@mail7.example.com", "+1 (555) 123-4567"}
    assert {texts[last][s["start"] : s["end"]] for s in got[last]["base"]} == {"10.1.2.3", "4111 1111 1111 1111"}
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in got.values())
    clean = rows_of(redact(found))
    assert clean[last - 1]["text"].startswith("mail me at [EMAIL] or [PHONE]") and clean[0]["text"] == texts[0] and clean[19]["text"] is None


def test_email_rule_equals_its_pattern():
    rule = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(1)
    for _ in range(3_000):
        t = "".join(rng.choices("ab.@_ -é", k=rng.randint(0, 25)))
        assert [(a, b) for a, k, b in base_spans(t) if k == 0] == [m.span() for m in rule.finditer(t)], t


def test_repeats(docs, texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + 200] for t in data for k in range(len(t) - 199))
    got = rows_of(cut_repeats(docs))
    for i, t in enumerate(data):
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(t), sum(gone), spans)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p><b>x\n y<br><p>z</p><div class='comments'><p>me</p></div></article><footer>f</footer></body>"
    loose = "<body><header>Top</header><p>Only &eacute; text</p><aside>ad</aside></body>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", page), (3, None, None), (4, "http://k/", loose), (5, "x", "")]
    got = rows_of(extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")), "page_id")
    assert [got[i]["text"] for i in range(1, 6)] == ["A & B\nx y\nz"] * 2 + ["", "Only é text", ""]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 20))
    vectors = [(c + rng.normal(size=20) * 0.08).tolist() for c in centre for _ in range(6)] + [centre[0].tolist()] * 3
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 20, 1), (n + 2, [float("nan")] * 20, 1), (n + 3, vectors[0], None), (n + 4, [None] * 20, 0), (n + 5, [], 0)]
    got = rows_of(embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")), "vec_id")
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.arange(n)[:, None] % 2 == np.arange(n)[None, :] % 2) & ~np.eye(n, dtype=bool)
    label = smallest_reachable(range(n), list(zip(*np.nonzero(near))))
    assert near.any() and len(got) == len(rows)
    for i in range(len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"]) == ((near[i].sum(), label[i]) if i < n else (0, i))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    vectors, pages = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"), spark.createDataFrame([], "page_id bigint, url string, html string")
    made = [
        shard_documents(docs, shards=4), decontaminate(docs, bench), jaccard_groups(docs), fit_quality(docs, docs.select("doc_id")).judge(docs),
        find_pii(docs, fit_pii(docs)), cut_repeats(docs), extract_text(pages), embedding_links(vectors),
        pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")), count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_quality_tells_word_salad(spark):
    """Known words in an order never seen are less likely than a text in the trained order, letter for letter the same."""
    rng = random.Random(2)
    phrases = [sentence(rng, 6) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(phrases, k=30)), "en") for i in range(60)]
    test = " ".join(phrases[k % 40] for k in range(7, 47))
    salad = test.split()
    rng.shuffle(salad)
    docs = spark.createDataFrame([*rows, (100, test, "en"), (101, " ".join(salad), "en")], "doc_id bigint, text string, lang string")
    got = rows_of(fit_quality(docs, docs.where("doc_id < 60").select("doc_id")).judge(docs))
    assert got[101]["perplexity"] > 1.5 * got[100]["perplexity"] and got[100]["kept"] and not got[101]["kept"]


def test_quality_sums_kneser_ney(spark):
    """The values joined to a text's n-grams add up to plain interpolated Kneser-Ney."""
    from wardbook.llm import quality

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(1, 9))), "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit_quality(docs, docs.select("doc_id"))
    got = rows_of(model.judge(docs))
    for fold in range(2):
        c3 = Counter()
        for _, t, _ in rows:
            if quality.fold_of(t) == fold:
                w = ["<", "<", *t.split(), ">"]
                c3.update(zip(w, w[1:], w[2:]))
        c2 = Counter(g[1:] for g in c3)
        c1 = Counter(g[1:] for g in c2)
        spelling = quality._Reader(model.spelling.value)

        def p(gram, orders):
            if not orders:
                return float(np.exp(quality.END_LOG_P if gram[-1] == ">" else spelling.spell([gram[-1]], fold)[0]))
            c, lower = orders[0], p(gram[1:] if len(orders) > 1 else gram, orders[1:])
            d = quality.discounts(*(sum(v == k for o in all_orders[len(orders) - 1] for v in o.values()) for k in (1, 2, 3, 4)))
            seen = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
            total = sum(seen.values())
            if not total:
                return lower
            freed = sum(d[min(v, 3)] for v in seen.values())
            return (max(c[gram] - d[min(c[gram], 3)], 0) + freed * lower) / total

        both = []
        for f in range(2):
            a = Counter()
            for _, t, _ in rows:
                if quality.fold_of(t) == f:
                    w = ["<", "<", *t.split(), ">"]
                    a.update(zip(w, w[1:], w[2:]))
            b = Counter(g[1:] for g in a)
            both.append((a, b, Counter(g[1:] for g in b)))
        all_orders = [[o[2] for o in both], [o[1] for o in both], [o[0] for o in both]]
        for i, t, _ in rows[:20]:
            if quality.fold_of(t) != fold:
                w = ["<", "<", *t.split(), ">"]
                logs = [np.log(p(g, [c3, c2, c1])) for g in zip(w, w[1:], w[2:])]
                assert got[i]["perplexity"] == pytest.approx(np.exp(-sum(logs) / (len(t) + 2)), rel=1e-5)


def test_quality_cuts_use_both_classes(spark):
    """Bad texts inside the widened quantiles of the good ones are cut off, by their mean or by one part."""
    from wardbook.llm.quality import fit_cuts

    rows = [("en", True, 4 + i % 20 / 10, 4 + i % 20 / 10, 4 + i % 20 / 10) for i in range(400)] + [("en", True, 14.0, 14.0, 14.0)]
    rows += [("en", False, 10.0 + i / 100, 10.0, 12.0) for i in range(60)] + [("en", False, 5.0, 1.5, 5.5)] * 20 + [("xx", True, 5.0, 5.0, 5.0)]
    cuts = rows_of(fit_cuts(spark.createDataFrame(rows, "_lang string, good boolean, perplexity double, lowest double, highest double"), 0.002, 1.1), "_lang")
    for name in ("en", "xx", None):
        assert 6 < cuts[name]["high"] < 10 and cuts[name]["low"] < 4 and 1.5 < cuts[name]["part_low"] < 4.1 and cuts[name]["part_high"] > 5.9


def test_html_keeps_articles_inside_marked_tags(spark):
    article = "<article><h1>T</h1><p>text</p></article>"
    pages = [
        f"<body><div class='content with-sidebar no-sidebar ad-free' id=search-results>{article}</div></body>",
        f"<body><div class=sidebar>{article}</div><div class=sidebar>ad</div></body>",
        f"<body><form action=/><input name=s><nav>Menu</nav>{article}</form></body>",
        f"<body><svg viewBox='0 0 1 1'/>{article}</body>",
        f"<body>{article}<div class=comments><article><p>me</p></article></div></body>",
        "<body><main><p>long enough to be the text</p><p>T</p><form><input><p>Send</p></form></main></body>",
    ]
    rows = [(i, f"http://h{i}/", p) for i, p in enumerate(pages)]
    got = rows_of(extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")), "page_id")
    assert [got[i]["text"] for i in range(6)] == ["T\ntext"] * 5 + ["long enough to be the text\nT"]
