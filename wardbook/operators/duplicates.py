"""Exact duplicate rows and repeated keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wardbook.session import settle

HASH, WORD = "__row_hash", "__word"
FILTER_BITS = 1 << 26  # at most 2^20 words of 64 bits are broadcast, about 32 MB
BITS_PER_HASH = 16


def duplicate_summary(df: DataFrame, keys: Sequence[str] | None = None, expected_rows: int | None = None) -> DataFrame:
    """Row count, distinct keys and surplus copies; nulls count as equal.

    Only rows that pass the sieve are compared in full (see ``_sieve``). A group
    of copies is counted on the map side first, whatever its size.
    """
    columns = list(keys) if keys else df.columns
    passed, n_rows = _sieve(df.select(*columns), columns)
    groups = settle(passed, "suspects").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    surplus = groups.agg(F.expr(f"{n_rows}L AS n_rows"), F.expr("coalesce(sum(n - 1), 0L) AS n_duplicates"))
    return surplus.select(
        "n_rows",
        (F.col("n_rows") - F.col("n_duplicates")).alias("n_distinct"),
        "n_duplicates",
        *([(F.col("n_rows") == expected_rows).alias("as_expected")] if expected_rows is not None else []),
    )


def _hash_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.xxhash64(*columns).alias(HASH)).groupBy(HASH).agg(F.count(F.lit(1)).alias("n"))


def _sieve(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, int]:
    """The rows that may have copies, as a plan, and the number of all rows.

    A first pass counts 64-bit hashes and writes the repeated ones; only hashes
    and counts are shuffled. They become a bit set, which is broadcast as words
    of 64 bits: it grows with the repeated hashes up to a fixed size. In the
    second pass no row moves; those without their bit have no copy. A full
    bit set lets more rows through, which changes the cost only.
    """
    seen = Observation()
    counts = _hash_counts(df, columns).observe(
        seen, F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.expr("count_if(n > 1) AS repeated")
    )
    repeated = settle(counts.where("n > 1").select(HASH), "repeated-hashes")
    bits = 64
    while bits < min(BITS_PER_HASH * seen.get["repeated"], FILTER_BITS):
        bits *= 2
    place = f"pmod({HASH}, {bits}L)"
    words = (
        repeated.selectExpr(f"{place} div 64 AS {WORD}", f"shiftleft(1L, CAST({place} % 64 AS INT)) AS bit")
        .groupBy(WORD)
        .agg(F.expr("bit_or(bit) AS __bits"))
    )
    hit = f"{place} div 64 = {WORD} AND shiftright(__bits, CAST({place} % 64 AS INT)) & 1L = 1L"
    hashed = df.withColumn(HASH, F.xxhash64(*columns))
    return hashed.join(F.broadcast(words), F.expr(hit), "left_semi").select(*df.columns), seen.get["rows"]


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Every row whose key (or whole content) occurs more than once, all copies listed.

    Rows that pass the sieve (see ``_sieve``) are written once when this is
    called. Repeated keys are found among them by a map-side combined count and
    joined back, so a key with very many copies is never gathered in one task:
    adaptive execution splits its side of the join.
    """
    columns = list(keys) if keys else df.columns
    df = settle(_sieve(df, columns)[0], "suspects")
    repeated = (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select([F.col(c).alias(f"__{i}") for i, c in enumerate(columns)])
    )
    same = reduce(and_, [df[c].eqNullSafe(repeated[f"__{i}"]) for i, c in enumerate(columns)])
    return df.join(repeated, same, "left_semi")


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """Number of distinct known values."""
    return df.agg(F.count_distinct(col).alias("n_distinct"))
