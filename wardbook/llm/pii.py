"""Operator 6: personal data by rules and by boosted trees over proposed spans."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.session import settle

KINDS = ("email", "ip", "card", "phone")
# Spans of each kind used to fit the trees, chosen by hash: at most this many.
MAX_TRAINING_SPANS = 6_000
SAMPLE_CELLS = 16_384
# A task holds so many examples, or so many texts with their spans, before it passes them on.
HELD_EXAMPLES = 2_000
HELD_TEXTS = 256

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider proposals, which may overlap each other and the spans of the rules.
WIDE_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++ ?(?:@|\(at\)|\[at\]) ?[\w-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]++)++")
WIDE_NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+")


def luhn(digits: str) -> bool:
    twice = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(filter("0123456789".__contains__, s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, looked for from each @, so that long runs of letters are read once."""
    done = 0
    while (at := text.find("@", done)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of wide proposals; a number is proposed for each kind that numbers may have."""
    out = [(0, m.start(), m.end()) for m in WIDE_EMAIL.finditer(text)] if "@" in text or "at)" in text or "at]" in text else []
    for m in WIDE_NUMBER.finditer(text):
        out += [(k, m.start(), m.end()) for k in (1, 2, 3)]
    return out


def features(text: str, start: int, end: int) -> list[float]:
    """Format and value of the span and its surroundings."""
    s, before, after = text[start:end], text[max(0, start - 12) : start].lower(), text[end : end + 2]
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    return [
        len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count("."), s.count("-"), s.count(" "), s.count("("), s.count("/"), s.startswith("+"), "@" in s, "dot" in s,
        before[-1:].isspace() or not before, before[-1:].isalnum(), after[:1].isspace() or not after, after[:1].isalnum(),
        any(w in before for w in ("tel", "phone", "call", "fax", "mobil")), any(w in before for w in ("card", "visa", "account", "iban")),
        any(w in before for w in ("mail", "contact")), any(w in before for w in ("ip", "host", "addr")), before[-1:] in "\"'=:",
        12 <= len(digits) <= 19 and luhn(digits), len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), s.startswith("00"),
    ]


def altered(kind: int, span: str, pick: int) -> str:
    """The span of a rule written in a way that the rules do not know; ``pick`` chooses the way."""
    digits = _digits(span)
    if kind == 0:
        name, _, domain = span.partition("@")
        return (f"{name} (at) {domain.replace('.', ' (dot) ')}", f"{name}[at]{domain}", f"{name} @ {domain}", f"{name}[at]{domain.replace('.', '[dot]')}")[pick % 4]
    if kind == 1:
        return (". ", "-", " .", "/")[pick % 4].join(span.split("."))
    if kind == 2:
        return (".", "/", "  ", "- ")[pick % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    rest = "-".join(digits[i : i + 3] for i in range(2, len(digits), 3))
    return (f"00{digits[:2]} {rest}", f"00{digits[:2]}/{rest}", f"(+{digits[:2]}) {rest}", f"00 {digits[:2]} {rest.replace('-', ' ')}")[pick % 4]


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """(kind, label, features) from one text, whatever its length.

    Proposals the rules accept as they stand are positive, those no accepted
    span of their kind overlaps negative. Each accepted span also gives a
    positive in another way of writing, and, where a value can be wrong, a negative of that
    shape with other digits, both in the place of the span.
    """
    base = base_spans(text)
    accepted = {(k, a, b) for a, k, b in base}
    for k, a, b in proposals(text):
        if (k, a, b) in accepted:
            yield k, 1, features(text, a, b)
        elif not any(k == kind and a < e and s < b for s, kind, e in base):
            yield k, 0, features(text, a, b)
    for a, k, b in base:
        pick = zlib.crc32(text[a:b].encode())
        other = altered(k, text[a:b], pick)
        wrong = re.sub("[0-9]", lambda m: "9482705163"[int(m[0])], other)
        for label, span in ((1, other), (0, wrong)):
            before = text[max(0, a - 12) : a]
            place = before + span + text[b : b + 2]
            if (k, len(before), len(before) + len(span)) not in proposals(place):
                continue
            found = features(place, len(before), len(before) + len(span))
            # Another address or telephone number is as good as the first; a wrong check digit or part is not.
            if label or (k in (1, 2) and not found[-3 if k == 2 else -2]):
                yield k, label, found


class Boosted:
    """Gradient boosting of depth-two trees on the logistic loss, with a threshold calibrated on held-out texts' spans."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int, rate: float, precision: float):
        self.trees, self.rate, self.start, self.threshold = [], rate, 0.0, np.inf
        fit = ~held
        if y[fit].sum() < 5 or y[held].sum() < 2:
            return  # too little to learn from: nothing is added
        mean = y[fit].mean()
        self.start = float(np.log(mean / (1 - mean))) if mean < 1 else 8.0
        score = np.full(fit.sum(), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._split(x[fit], y[fit] - p, p * (1 - p), 2)
            self.trees.append(tree)
            score += rate * self._leaf(tree, x[fit])
        # The lowest score above which the held-out proposals are precise enough.
        s, t = self.score(x[held]), y[held]
        for cut in np.unique(s)[::-1]:
            chosen = s >= cut
            # A span is never added that is likelier to be none.
            if cut >= 0 and t[chosen].mean() >= precision:
                self.threshold = cut
            else:
                break

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = float(g.sum() / (h.sum() + 1))
        if depth == 0 or len(g) < 4:
            return value
        best, choice = g.sum() ** 2 / (h.sum() + 1) + 1e-6, None
        for j in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[:-1])):
                low = x[:, j] <= cut
                if 0 < low.sum() < len(g):
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1)
                    if gain > best:
                        best, choice = gain, (j, float(cut))
        if choice is None:
            return value
        low = x[:, choice[0]] <= choice[1]
        return (*choice, self._split(x[low], g[low], h[low], depth - 1), self._split(x[~low], g[~low], h[~low], depth - 1))

    def _leaf(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._leaf(low, x), self._leaf(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._leaf(t, x) for t in self.trees), np.zeros(len(x)))


def example_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, number, kind, label, x) from batches of (of, text), of at most ``HELD_EXAMPLES`` rows, however many a batch or one text gives."""
    names = ["of", "number", "kind", "label", "x"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        held = []
        for of, t in zip(batch.column(0), batch.column(1)):
            key = of.as_py()
            for n, (kind, label, x) in enumerate(examples(t.as_py() or "")):
                held.append((key, n, kind, label, [float(v) for v in x]))
                if len(held) >= HELD_EXAMPLES:
                    yield made(held)
                    held = []
        if held:
            yield made(held)


def fit_pii(df: DataFrame, text: str = "text", max_spans: int = MAX_TRAINING_SPANS, rounds: int = 30, rate: float = 0.3, precision: float = 0.95) -> list[Boosted]:
    """One model per kind, fitted on at most ``max_spans`` examples of it from all texts, whole ones of any length.

    Where the examples and their labels come from is told in ``examples``. They
    are made where the texts are read and written as features; of each kind and
    label those with the smallest hashes of text and place are taken, half of
    the bound for either label, so the choice does not depend on partitions, and copies of a
    text count once. A quarter of the texts is held out: the threshold of a kind
    is the lowest score, of even odds at least, down to which their examples are as precise as ``precision``. A kind
    with too few examples has no model and adds nothing.
    """

    made = df.select(F.xxhash64(text).alias("of"), F.col(text).alias("t")).mapInArrow(example_batches, "of bigint, number int, kind int, label int, x array<double>")
    made = made.withColumn("cell", F.pmod(F.xxhash64("of", "number"), F.lit(SAMPLE_CELLS)).cast("int"))
    made = settle(made.dropDuplicates(["of", "number"]), "examples")
    counts = np.zeros((len(KINDS), 2, SAMPLE_CELLS), np.int64)
    for r in made.groupBy("kind", "label", "cell").agg(F.count("*").alias("n")).collect():
        counts[r["kind"], r["label"], r["cell"]] = r["n"]
    cells = (np.cumsum(counts, axis=2) <= max_spans // 2).sum(2)
    chosen = " OR ".join(f"(kind = {k} AND label = {y} AND cell < {cells[k, y]})" for k in range(len(KINDS)) for y in (0, 1))
    rows = made.where(chosen).orderBy("of", "number").toPandas()
    models = []
    for k in range(len(KINDS)):
        mine = rows[rows["kind"] == k]
        x = np.array(mine["x"].tolist(), float).reshape(len(mine), -1) if len(mine) else np.empty((0, 1))
        models.append(Boosted(x, mine["label"].to_numpy(), mine["of"].to_numpy() % 4 == 3, rounds, rate, precision))
    return models


def added_spans(text: str, base: list[tuple[int, int, int]], models: list[Boosted]) -> list[tuple[int, int, int]]:
    """Proposals above their kind's threshold that no span of the rules overlaps; of overlapping ones the best."""
    open_ = [(k, a, b) for k, a, b in proposals(text) if models[k].trees and not any(a < e and s < b for s, _, e in base)] if any(m.trees for m in models) else []
    if not open_:
        return []
    x = np.array([features(text, a, b) for _, a, b in open_], float)
    scored = []
    for k in {k for k, _, _ in open_}:
        mine = [i for i, o in enumerate(open_) if o[0] == k]
        margin = models[k].score(x[mine]) - models[k].threshold
        scored += [(-m, open_[i]) for m, i in zip(margin, mine) if m >= 0]
    out: list[tuple[int, int, int]] = []
    for _, (k, a, b) in sorted(scored):
        if not any(a < e and s < b for s, _, e in out):
            out.append((a, k, b))
    return out


def find_pii(df: DataFrame, models: list[Boosted], text: str = "text") -> DataFrame:
    """Append ``base`` and ``spans``: arrays of (kind, start, end) in code points, by start, then kind.

    ``base`` are the rules' spans and ``spans`` adds those the models select.
    A null text counts as empty and has none; columns called base or spans are
    replaced; rows stay where they are, so texts are read once and whole.
    """
    kept = df.drop("base", "spans")
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    shared = df.sparkSession.sparkContext.broadcast(models)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HELD_TEXTS):
                part = batch.slice(at, HELD_TEXTS)
                base, every = [], []
                for value in part.column(text):
                    t = value.as_py() or ""
                    found = base_spans(t)
                    base.append(named(found))
                    every.append(named(sorted(found + added_spans(t, found, shared.value))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(base, arrow), pa.array(every, arrow)], names=[*part.schema.names, "base", "spans"])

    schema = kept.select("*", F.lit(None).cast(span).alias("base"), F.lit(None).cast(span).alias("spans")).schema
    return kept.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of ``spans`` in the text by its kind in brackets; overlapping spans become one."""
    pieces = F.expr(f"""aggregate(spans, named_struct('done', '', 'at', 0L), (s, x) ->
        if(x.end <= s.at, s, named_struct('done', concat(s.done, if(x.start >= s.at, concat(substring({text}, cast(s.at + 1 as int), cast(x.start - s.at as int)), '[', upper(x.kind), ']'), '')), 'at', x.end)))""")
    out = F.concat(pieces["done"], F.substring(F.col(text), pieces["at"].cast("int") + 1, F.length(text)))
    return df.withColumn(text, F.when(F.size("spans") > 0, out).otherwise(F.col(text)))
