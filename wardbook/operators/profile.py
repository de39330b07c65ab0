"""Column profiles: missing cells, summary statistics, value counts, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.literals import wide_to_long
from wardbook.functions.numbers import percent, ratio
from wardbook.functions.predicates import literal, name
from wardbook.operators.ranking import number, quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and percentage of every column that has nulls, most first."""
    counts = df.selectExpr("count(*) AS n_rows", *[f"count({name(c)}) AS c{i}" for i, c in enumerate(df.columns)])
    entries = [{"column": literal(c), "n_missing": f"n_rows - c{i}"} for i, c in enumerate(df.columns)]
    long = wide_to_long(counts, entries, keep=["n_rows"]).where("n_missing > 0")
    return long.selectExpr("column", "n_missing", f"{percent('n_missing', 'n_rows')} AS pct_missing").orderBy(
        F.desc("n_missing"), "column"
    )


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, quartiles and maximum of each column."""
    measures = {"count": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    stats = df.selectExpr(
        *[f"{fn}({name(c)}) AS {measure}_{i}" for i, c in enumerate(cols) for measure, fn in measures.items()]
    )
    kinds = {m: "BIGINT" if m == "count" else "DOUBLE" for m in measures}
    entries = [
        {"column": literal(c)} | {m: f"CAST({m}_{i} AS {kind})" for m, kind in kinds.items()}
        for i, c in enumerate(cols)
    ]
    return wide_to_long(stats, entries).join(quantiles(df, cols, QUARTILES, exact), "column", "left")


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Rows per value and their share of all rows counted."""
    rows = df.where(f"{name(col)} IS NOT NULL") if dropna else df
    counts = rows.groupBy(col).agg(F.expr("count(*) AS n"))
    total = counts.selectExpr("CAST(sum(n) AS DOUBLE)").scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), F.asc(col))


def value_counts_many(df: DataFrame, cols: Sequence[str], dropna: bool = False) -> DataFrame:
    """Value counts of several code columns in long form, with the share within each column."""
    pairs = ", ".join(f"{literal(c)}, CAST({name(c)} AS BIGINT)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, value)")
    if dropna:
        long = long.where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.expr("count(*) AS n"))
    # One row per listed column, so small whatever the table.
    sizes = counts.groupBy("column").agg(F.expr("sum(n) AS size"))
    return counts.join(sizes.hint("broadcast"), "column").selectExpr(
        "column", "value", "n", f"{ratio('n', 'size')} AS share"
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum, the last one closed, empty bins included; NaN counts as missing."""
    values = df.selectExpr(f"{number(col)} AS x").where("x IS NOT NULL")
    bounds = values.selectExpr(
        "named_struct('lo', CASE WHEN min(x) < max(x) THEN min(x) ELSE min(x) - 0.5D END,"
        " 'hi', CASE WHEN min(x) < max(x) THEN max(x) ELSE max(x) + 0.5D END)"
    ).scalar()
    width = f"((b.hi - b.lo) / {bins})"
    placed = values.withColumn("b", bounds).selectExpr(
        f"CAST(least(floor((x - b.lo) / {width}), {bins - 1}) AS INT) AS bin"
    )
    counts = placed.groupBy("bin").agg(F.expr("count(*) AS n"))
    grid = df.sparkSession.range(bins).selectExpr("CAST(id AS INT) AS bin")
    # Both sides hold at most one row per bin.
    return grid.join(counts.hint("broadcast"), "bin", "left").withColumn("b", bounds).selectExpr(
        "bin",
        f"b.lo + bin * {width} AS lower",
        f"b.lo + (bin + 1) * {width} AS upper",
        "coalesce(n, 0) AS n",
    )


def box_stats(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers (the extreme values within 1.5 IQR of the box) and the number of outliers; NaN counts as missing."""
    box = quantiles(df, [col], QUARTILES, exact).selectExpr("struct(q1, median, q3)").scalar()
    placed = df.select(F.expr(f"{number(col)} AS x"), box.alias("b"))
    inside = "x BETWEEN b.q1 - (b.q3 - b.q1) * 1.5D AND b.q3 + (b.q3 - b.q1) * 1.5D"
    return placed.selectExpr(
        *[f"first(b.{q}) AS {q}" for q in QUARTILES],
        f"min(CASE WHEN {inside} THEN x END) AS whisker_low",
        f"max(CASE WHEN {inside} THEN x END) AS whisker_high",
        f"count_if(NOT ({inside})) AS n_outliers",
    )


def group_rate(df: DataFrame, by: str, outcome: str) -> DataFrame:
    """Mean of a 0/1 outcome per group, missing outcomes ignored."""
    return df.groupBy(by).agg(F.count(outcome).alias("n"), F.avg(outcome).alias("rate"))


def split_counts(df: DataFrame, col: str, cut: float) -> DataFrame:
    """Rows below the cut, at or above it, and without a value."""
    return df.selectExpr(
        f"count_if({name(col)} < {literal(cut)}) AS n_below",
        f"count_if({name(col)} >= {literal(cut)}) AS n_from",
        f"count_if({name(col)} IS NULL) AS n_missing",
    )
