"""Operator 2: benchmark decontamination with native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.session import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Up to this many windows the set is broadcast: with a gram of some 100 bytes
# and its row that is at most about 100 MB. A larger set is joined by shuffling.
BROADCAST_WINDOWS = 500_000
# Size of the bit set that sorts out most windows before their text is built,
# in 64-bit words: 64 bits per benchmark window, and never more than this.
MAX_FILTER_WORDS = 1 << 16
# A larger set of windows is joined by shuffling, with each window on this many keys.
SALTS = 32


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _window_hashes(hashes: Column, length: Column | int) -> Column:
    """The hash of each run of ``length`` word hashes."""
    n = F.lit(length) if isinstance(length, int) else length
    starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, n)))


def benchmark_windows(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (gram, length, item): every window of the items' words; an item of fewer words is one window."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(width))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.concat_ws(" ", F.slice("w", i, length)))
    return w.select("item", length.alias("len"), F.explode(grams).alias("gram")).distinct()


def _bit_masks(grams: DataFrame, n_bits: int, lengths: list[int]) -> dict[int, str]:
    """Per window length, a bit set of the window hashes as the SQL text of an array of 64-bit words."""
    gram_hash = F.xxhash64(F.transform(F.split("gram", " "), lambda x: F.xxhash64(x)))
    place = F.pmod(gram_hash, F.lit(n_bits))
    bits = grams.select("len", F.shiftright(place, 6).alias("at"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    bits = bits.groupBy("len", "at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    masks = {n: [0] * (n_bits // 64) for n in lengths}
    for r in bits.collect():  # at most one row per word of the bit sets
        masks[r["len"]][r["at"]] = r["mask"]
    word = lambda m: f"{m}L" if m > -(2**63) else "bigint('-9223372036854775808')"
    return {n: f"array({', '.join(map(word, m))})" for n, m in masks.items()}


def _candidates(n: int, masks: str, n_bits: int) -> Column:
    """The windows of ``n`` words whose hash is in the bit set, with their text."""
    word, bit = F.expr(masks), lambda x: F.pmod(x, F.lit(64)).cast("int")
    is_set = lambda x: F.getbit(F.get(word, F.shiftright(F.pmod(x, F.lit(n_bits)), 6).cast("int")), bit(x)) == 1
    starts = F.filter(F.transform(_window_hashes(F.col("h"), n), lambda x, i: F.when(is_set(x), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.concat_ws(" ", F.slice("w", i + 1, n)).alias("gram")))


def window_hits(documents: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, windows): hits has a row per document with ``at`` -1 and one per hit window, numbered by input row.

    A bit set made from the benchmark's window hashes sorts out nearly all
    windows of a document without building their text. The rest are joined
    with the windows themselves, so a hit never rests on a hash. Hits are
    written once, because spans and items are both counted from them.
    """
    windows = settle(benchmark_windows(benchmark, width, item, item_text), "windows")
    grams = windows.select("gram", "len").distinct()
    sizes = grams.groupBy("len").agg(F.count("*").alias("n")).collect()  # at most ``width`` rows
    total = sum(r["n"] for r in sizes)
    n_bits = 64 * 64
    while n_bits < 64 * total and n_bits < 64 * MAX_FILTER_WORDS:
        n_bits *= 2

    base = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("w"))
    base = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    found = [F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit("").alias("gram")))]
    for n, masks in sorted(_bit_masks(grams, n_bits, [r["len"] for r in sizes]).items()):
        found.append(_candidates(n, masks, n_bits))
    rows = base.select("row", "key", F.size("w").cast("bigint").alias("n_words"), F.inline(F.concat(*found)))
    known = grams.withColumn("known", F.lit(True))
    if total <= BROADCAST_WINDOWS:
        hits = rows.join(F.broadcast(known), ["gram", "len"], "left")
    else:  # a passage in very many documents is spread over the salts
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = rows.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "len", "salt"], "left")
    hits = hits.where("known OR at < 0").select("row", "key", "n_words", "at", "len", "gram")
    return settle(hits, "hits"), windows


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: key, n_words, n_hit, spans (start, end in words), items (sorted ids), contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters, in lower
    case. A document word is hit if it lies in any occurrence of a window of
    ``width`` item words; an item of fewer words is one window. A null or empty
    text has no words and is never contaminated, nor does an empty or null item
    hit anything. Repeated rows give a result each; equal items are all listed;
    other columns are left out.
    """
    hits, windows = window_hits(documents, benchmark, width, key, text, item, item_text)
    spans = F.sort_array(F.collect_list(F.when(F.col("at") >= 0, F.struct(F.col("at"), (F.col("at") + F.col("len")).alias("until")))))
    per_row = hits.groupBy("row").agg(F.first("key").alias(key), F.max("n_words").alias("n_words"), spans.alias("windows"))
    # Overlapping and touching windows become one span.
    merged = F.expr("""aggregate(windows, cast(array() as array<struct<start:int,end:int>>), (done, x) ->
        if(size(done) > 0 and try_element_at(done, -1).end >= x.at,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', try_element_at(done, -1).start, 'end', greatest(try_element_at(done, -1).end, x.until)))),
           concat(done, array(named_struct('start', x.at, 'end', x.until)))))""")
    # The windows of one document are few against its words; their items are joined by window.
    grams = hits.where("at >= 0").select("row", "gram", "len").distinct()
    items = grams.join(windows, ["gram", "len"]).select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = per_row.withColumn("spans", merged).join(items, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select(key, "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
