"""Wrappers of pages: what only the other pages of a host can tell."""

from __future__ import annotations

import random

import pytest

from wardbook.llm.html_text import align, article, block_key, blocks, content_paths, extract_text, fixed_blocks, page_wrapper

SCHEMA = "page_id bigint, url string, html string, host string, paths string, fixed int, page string, text string"


def texts_of(spark, pages):
    rows = [(i, url, html, "x", "x", 1, "x", "x") for i, (url, html) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def alone(html):
    found = blocks(html)
    return article(found, content_paths(page_wrapper(found, {})), {})


def test_a_template_is_known_by_its_other_pages(spark):
    notice = "<p>" + "This long notice stands on every page. " * 10 + "</p>"
    pages = [(f"http://h/{k}", f"<body><h1>Title {k}</h1><p>a{k}</p>{notice}<p>Read more</p><blockquote>q{k}</blockquote></body>") for k in range(5)]
    got = texts_of(spark, pages)
    assert [got[k] for k in range(5)] == [f"Title {k}\na{k}\nq{k}" for k in range(5)]
    assert all(alone(html) != got[k] for k, (_, html) in enumerate(pages))


def test_a_template_inside_the_article(spark):
    page = "<article><h1>T{0}</h1><p>text {0}</p><div><p>Rate this article</p></div><p>end {0}</p></article>"
    got = texts_of(spark, [(f"https://n.example/{k}", page.format(k)) for k in range(4)])
    assert [got[k] for k in range(4)] == [f"T{k}\ntext {k}\nend {k}" for k in range(4)]


def test_copied_pages_keep_their_article(spark):
    page = "<body><p>first paragraph</p><p>second paragraph</p><p>third</p>{}</body>"
    foot = "<div>Imprint and terms of use</div>"
    pages = [("http://c/1", page.format(foot))] * 4 + [("http://c/2", page.format("<p>one more</p>" + foot)), ("http://c/3", f"<body><p>else</p><p>other</p>{foot}</body>")]
    got = texts_of(spark, pages)
    assert [got[k] for k in range(4)] == ["first paragraph\nsecond paragraph\nthird"] * 4
    assert got[4].startswith("first paragraph\nsecond paragraph\nthird\none more") and got[5] == "else\nother"


def test_single_pages_lose_nothing(spark):
    body = "<h1>Title</h1><p>a</p><h2>Sub</h2><p>b</p><blockquote>quote</blockquote><p>c</p><ul><li>d</li><li>e</li></ul>"
    got = texts_of(spark, [("http://one/", body), ("http://two/", body), (None, body), ("http://three/", f"<main>{body}</main><p>out</p>")])
    assert set(got.values()) == {"Title\na\nSub\nb\nquote\nc\nd\ne"}


@pytest.mark.parametrize("name", ["ad-box", "adbox", "reader-comments", "site-notice", "siteNotice", "cookie_banner", "Sidebar left"])
def test_words_mark_parts_of_names(spark, name):
    page = f"<article><h1>T</h1><p>a text that is the bulk of the page</p><div class='{name}'><p>away</p></div></article>"
    kept = f"<body><div class='{name}'><p>a text that is the bulk of the page</p></div><div class='{name} x'>away</div></body>"
    assert list(texts_of(spark, [("http://h/", page), ("http://k/", kept)]).values()) == ["T\na text that is the bulk of the page", "a text that is the bulk of the page"]


def test_very_long_pages_and_repeated_rows(spark):
    rng = random.Random(1)
    long = "".join(f"<p>{rng.random()} {'w ' * 40}</p>" for _ in range(20_000))
    got = texts_of(spark, [("http://l/1", long), ("http://l/1", long), ("http://l/2", "<p>short</p>"), ("http://l/3", ""), (None, None)])
    assert got[0] == got[1] and got[0].count("\n") == 19_999 and got[2] == "short" and got[3] == got[4] == ""


def test_alignment_is_an_expression_without_alternatives():
    fixed = {block_key("p", "menu"): 3, block_key("div", "end"): 3}
    left = page_wrapper([("p", "menu"), ("h1", "a"), ("p", "b"), ("p", "c"), ("div", "end")], fixed)
    right = page_wrapper([("p", "menu"), ("p", "d"), ("ul/li", "e"), ("div", "end")], fixed)
    key = {i[1] for i in left} - {None}
    assert [(i[0], i[1] in key, i[2], i[3]) for i in align(left, right)] == [
        ("p", True, False, False), ("h1", False, False, True), ("p", False, True, False), ("ul/li", False, False, True), ("div", True, False, False),
    ]
    assert align(left, left) == [[*i[:4], 2 * i[4]] for i in left]


def test_fixed_blocks_against_counts():
    found = [("p", "x"), ("p", "y"), ("p", "menu")]
    assert fixed_blocks(found, {block_key("p", "menu"): 9}) == [False, False, True]
    assert fixed_blocks(found, {block_key("p", t): 9 for t in ("x", "y", "menu")}) == [False] * 3
    assert fixed_blocks([], {}) == []
