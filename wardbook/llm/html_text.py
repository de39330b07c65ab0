"""Operator 8: main text of web pages by wrappers inferred per host."""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.session import settle

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|select|svg|iframe|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Tags that don't end a block, and tags without content.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags and words of class, id or role that mark what isn't the article.
OUTSIDE_TAGS = frozenset("nav footer aside button dialog menu head".split())
FIELDS = frozenset("input select textarea button".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adbox adslot adspace adunit adwrap advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disqus footer form masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies reply search share "
    "sharing sidebar social sponsor sponsored subscribe widget".split()
)
WORD_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
MERGES = 32  # wrappers of one host are merged in so many groups first
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SAME = frozenset("li dt dd tr td th option".split())


class _Open:
    """An open block tag: its name with class and id, whether its tag or its words mark it as furniture, and for a form its fields and characters of text."""

    __slots__ = ("tag", "name", "outside", "worded", "fields", "chars")

    def __init__(self, tag: str, name: str, outside: bool, worded: bool):
        self.tag, self.name, self.outside, self.worded, self.fields, self.chars = tag, name, outside, worded, 0, 0

    def step(self) -> str:
        return ("!" if self.outside else "?" if self.worded else "") + self.name


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of each block of a page in order; a path names the open block tags with class and id, numbers in them as 0.

    ``!`` stands before tags that are furniture by their kind, ``?`` before
    those with a word for it in class, id or role, which the wrapper may
    overrule. A form is furniture if it has fields and less than half of the
    page's text. Where every article or main of a page lies in a tag marked by
    a word or in a form, those marks don't count.
    """
    out: list[tuple[list[_Open], str]] = []
    stack: list[_Open] = []
    text: list[str] = []
    page, at = page or "", 0

    def flush() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            out.append((list(stack), joined))
            for o in stack:
                o.chars += len(joined)

    for m in TOKEN.finditer(page):
        text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if (tag or (m["raw"] or "").lower()) in FIELDS and not m["end"]:
            for o in stack:
                o.fields += 1
        if not tag or tag in INLINE:
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        open_ = [o.tag for o in stack]
        if m["end"]:
            if tag in open_:
                del stack[len(open_) - 1 - open_[::-1].index(tag) :]
            continue
        if open_ and (open_[-1] in CLOSED_BY_BLOCK or (open_[-1] == tag and tag in CLOSED_BY_SAME)):
            stack.pop()
        marks = [w for a, b, c in MARK.findall(m["rest"]) for w in (a or b or c).split()]
        words = {w.lower() for mark in marks for w in (mark, *WORD_PART.findall(mark))}
        inside = any(t in ("article", "main") for t in open_)
        whole_page = tag in ("html", "body", "article", "main")
        outside = not whole_page and (tag in OUTSIDE_TAGS or (tag == "header" and not inside))
        name = re.sub(r"[0-9]+", "0", ".".join([tag, *sorted(set(marks))])).replace("/", "|")
        stack.append(_Open(tag, name, outside, not whole_page and bool(words & OUTSIDE_WORDS)))
    text.append(html.unescape(page[at:]))
    flush()
    whole = sum(len(t) for _, t in out)
    for o in {id(o): o for opened, _ in out for o in opened if o.tag == "form"}.values():
        o.outside = o.outside or (o.fields > 0 and 2 * o.chars < whole)
    around = [opened[: max(k for k, o in enumerate(opened) if o.tag in ("article", "main"))] for opened, _ in out if any(o.tag in ("article", "main") for o in opened)]
    if around and all(any(o.outside or o.worded for o in tags) for tags in around):
        for tags in around:
            for o in tags:
                o.outside, o.worded = o.outside and o.tag in OUTSIDE_TAGS, False
    return [("/".join(o.step() for o in opened), t) for opened, t in out]


def block_key(path: str, text: str) -> int:
    """What tells equal blocks of a host: 63 bits of path and text."""
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def fixed_blocks(found: list[tuple[str, str]], fixed: dict[int, int]) -> list[bool]:
    """Which blocks belong to the host's template: those on more pages than most of this page is.

    ``fixed`` counts the pages of blocks that more than half of the host's
    pages hold. "Most" is the smaller of two medians over the page's blocks,
    one by number and one by length, so an article that is copied to many pages
    stays on all of them, and neither a long notice nor a long menu hides a
    short article.
    """
    n = np.array([fixed.get(block_key(*x), 1) for x in found], np.int64)
    if len(n) == 0 or n.max() == 1:
        return [False] * len(n)
    order = np.argsort(n, kind="stable")
    ends = np.cumsum([len(found[i][1]) for i in order])
    by_length = n[order[np.searchsorted(ends, ends[-1] / 2)]]
    return (n > min(n[order[(len(n) - 1) // 2]], by_length)).tolist()


# A wrapper is a list of items [path, key or None for a slot, repeated, optional,
# characters in slots]: a regular expression without alternatives over the
# blocks of a host's pages.
Item = list


def page_wrapper(found: list[tuple[str, str]], fixed: dict[int, int]) -> list[Item]:
    """A page as a wrapper: fixed blocks keep their key, other neighbours of one path are a repeated slot."""
    out: list[Item] = []
    for (path, text), is_fixed in zip(found, fixed_blocks(found, fixed)):
        if is_fixed:
            out.append([path, block_key(path, text), False, False, 0])
        else:
            out.append([path, None, False, False, len(text)])
    return squeezed(out)


def squeezed(items: list[Item]) -> list[Item]:
    """Neighbouring slots as one repeated group: each path once, in the order of its first place."""
    out: list[Item] = []
    group: dict[str, Item] = {}
    for item in items:
        if item[1] is not None:
            group = {}
            out.append(item)
        elif item[0] in group:
            held = group[item[0]]
            held[2:] = [True, held[3] and item[3], held[4] + item[4]]
        else:
            group[item[0]] = item
            out.append(item)
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, whose second numbers rise."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        before.append(last[at - 1] if at else -1)
        tops[at : at + 1] = [j]
        last[at : at + 1] = [k]
    out: list[tuple[int, int]] = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(left: list[Item], right: list[Item]) -> list[Item]:
    """The wrapper of both, in time n log n.

    Fixed blocks that both hold once are the fixed points, in the longest run
    in which their order agrees. Between two of them, items of the same path
    are one slot, and what one side lacks is optional; slots that then are
    neighbours are one repeated group.
    """

    def once(items: list[Item]) -> dict[tuple, int]:
        seen = Counter((i[0], i[1]) for i in items if i[1] is not None)
        return {(i[0], i[1]): at for at, i in enumerate(items) if i[1] is not None and seen[i[0], i[1]] == 1}

    mine, other = once(left), once(right)
    points = _rising([(at, other[key]) for key, at in mine.items() if key in other])
    out: list[Item] = []
    a = c = 0
    for b, d in [*points, (len(left), len(right))]:
        spare: dict[tuple, Item] = {}
        for y in right[c:d]:
            spare.setdefault((y[0], y[1]), y)
        for x in left[a:b]:
            y = spare.pop((x[0], x[1]), None)
            out.append([x[0], x[1], x[2] or y[2], x[3] or y[3], x[4] + y[4]] if y else [*x[:3], True, x[4]])
        out += [[*y[:3], True, y[4]] for y in spare.values()]
        if b < len(left):
            x, y = left[b], right[d]
            out.append([x[0], x[1], False, x[3] or y[3], 0])
        a, c = b + 1, d + 1
    return squeezed(out)


def content_paths(wrapper: list[Item]) -> list[str]:
    """The paths that hold a host's article: inside article or main if there is one, else all outside furniture.

    A word in class, id or role makes furniture only of a region that holds at
    most half of the text that varies from page to page.
    """
    inside = [i for i in wrapper if not any(step.startswith("!") for step in i[0].split("/"))]
    held: Counter = Counter()
    for path, _, _, _, chars in inside:
        steps = path.split("/")
        for k, step in enumerate(steps):
            if step.startswith("?"):
                held["/".join(steps[: k + 1])] += chars
    half = sum(i[4] for i in inside) / 2
    marked = {prefix for prefix, chars in held.items() if chars <= half}
    free = [i for i in inside if not any(i[0] == prefix or i[0].startswith(prefix + "/") for prefix in marked)]
    named = [i for i in free if any(re.split(r"[.]", step.lstrip("?"))[0] in ("article", "main") for step in i[0].split("/"))]
    return sorted({i[0] for i in named or free})


def article(found: list[tuple[str, str]], paths: list[str] | None, fixed: dict[int, int]) -> str:
    """The text of a page's blocks on the given paths, without those of the template."""
    wanted = set(paths or ())
    if not any(p in wanted for p, _ in found):
        wanted = set(content_paths(page_wrapper(found, fixed)))
    chosen = [x for x in found if x[0] in wanted]
    return "\n".join(t for (_, t), drop in zip(chosen, fixed_blocks(chosen, fixed)) if not drop)


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _fixed(value) -> dict[int, int]:
    return {x["key"]: x["n"] for x in value.as_py() or ()}


def template_blocks(pages: DataFrame, page: str) -> DataFrame:
    """(host, fixed): blocks that more than half of a host's pages hold, and on how many pages; fewer per host than twice a page's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys = [], []
            for host, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {block_key(p, t) for p, t in blocks(value.as_py()) if not any(step.startswith("!") for step in p.split("/"))}
                if found:
                    found.add(-1)  # the page itself
                    keys += found
                    hosts += [host] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64())], names=["host", "key"])

    made = pages.select(_host().alias("host"), page).mapInArrow(run, "host string, key bigint")
    counted = settle(made.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1"), "recurring-blocks")
    pages_of = counted.where("key = -1").select("host", F.col("n").alias("pages"))
    often = counted.where("key <> -1").join(pages_of, "host").where("2 * n > pages")
    return settle(often.groupBy("host").agg(F.collect_list(F.struct("key", "n")).alias("fixed")), "template-blocks")


def infer_wrappers(pages: DataFrame, page: str = "html") -> DataFrame:
    """(host, paths, fixed): what each host's wrapper, from all its pages, takes for the article, and its template's blocks.

    Each task aligns the pages it reads, so a host gives at most one wrapper
    per task. Those are aligned with each other in two rounds, in up to
    ``MERGES`` groups per host first: no host's pages meet in one place.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Item]] = {}
        for batch in batches:
            for host, value, fixed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                one = page_wrapper(blocks(value.as_py()), _fixed(fixed))
                if one:
                    known[host] = align(known[host], one) if host in known else one
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())], names=["host", "wrapper"])

    def merged(frame: pd.DataFrame) -> list[Item]:
        whole: list[Item] = []
        for k, text in enumerate(sorted(frame["wrapper"])):
            whole = align(whole, json.loads(text)) if k else json.loads(text)
        return whole

    def per_part(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(merged(frame))]})

    def per_host(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "paths": [content_paths(merged(frame))]})

    fixed = template_blocks(pages, page)
    made = pages.select(_host().alias("host"), page).join(fixed, "host", "left").select("host", page, "fixed").mapInArrow(per_task, "host string, wrapper string")
    parts = made.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(MERGES)).alias("part")).applyInPandas(per_part, "host string, wrapper string")
    wrappers = parts.groupBy("host").applyInPandas(per_host, "host string, paths array<string>")
    return settle(wrappers.join(fixed, "host", "left"), "wrappers")


def extract_text(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """key, url and text: the blocks of each page that its host's wrapper takes for the article, joined by newlines.

    A null or empty page, or one without an article, gives an empty text. A
    null url is a host of its own. A page none of whose blocks fit the wrapper
    is read by a wrapper of its own. What more than half of a host's pages hold
    is no article, unless the page as a whole occurs that often. Pages and
    blocks may have any length. Repeated rows give a row each and count as
    pages; other columns are left out; an empty table gives no rows.
    """
    source = pages.select(F.col(key).alias("_key"), F.col("url").alias("url"), F.col(page).alias("page"))
    joined = source.withColumn("host", _host()).join(infer_wrappers(source, "page"), "host", "left").select("_key", "url", "page", "paths", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(blocks(value.as_py()), paths.as_py(), _fixed(fixed)) for value, paths, fixed in zip(*batch.columns[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, "url", "text"])

    return joined.mapInArrow(run, pages.select(key, "url", F.lit("").alias("text")).schema)
