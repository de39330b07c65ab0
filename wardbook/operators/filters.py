"""Row selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.predicates import equals


def restrict(df: DataFrame, flag: str) -> DataFrame:
    """Keep the population whose flag is 1."""
    return df.where(equals(flag, 1))


def drop_missing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    return df.dropna(subset=list(cols))


def peek(df: DataFrame, n: int, order_by: str | Sequence[str], last: bool = False) -> DataFrame:
    """The first or last n rows in the given order."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[F.desc(k) if last else F.asc(k) for k in keys]).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """Row and column count as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def top_k_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values with their counts, null excluded; on a tie the smaller value wins."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
        .limit(k)
    )


def filter_top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """Keep the rows whose value is among the k most frequent; Spark chooses the join by the list's size in bytes."""
    top = top_k_values(df, col, k).select(col)
    return df.join(top, col, "left_semi")
