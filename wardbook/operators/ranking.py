"""Running totals and quantiles over large tables without sorting them in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.predicates import literal, name
from wardbook.session import settle

SKETCH_SIZE = 4_000  # ranks off by 0.08 % of the rows


def ranged(df: DataFrame, order_by: str, partition_by: str | None = None) -> DataFrame:
    """The rows cut into ranges of about equal row numbers, written once, with the range's number as ``__range``.

    The cuts come from a sample of the rows, so ranges are even however the
    values lie: a far outlier or values crowded together change nothing. There
    are as many ranges as ``spark.sql.shuffle.partitions``.
    """
    keys = [F.col(partition_by)] if partition_by else []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, F.col(order_by))
    return settle(dealt.withColumn("__range", F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame,
    order_by: str,
    totals: Mapping[str, str],
    partition_by: str | None = None,
    descending: bool = False,
    sizes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running totals of columns, in the order of a column.

    ``totals`` maps an existing column to the name of its running total,
    ``sizes`` one to the name of its total over the whole partition.
    ``order_by`` is distinct within a partition, so callers group by it first.
    ``partition_by`` names a column with few values, such as a fold or a column
    name. The rows are written in ranges (see ``ranged``) when this is called.
    What lies before a range comes from a table with a row per range and
    partition, which is what is broadcast; each task sorts one range.
    """
    sizes = sizes or {}
    keys = [partition_by] if partition_by else []
    over, order = ", ".join(name(k) for k in keys), name(order_by)
    way = "DESC" if descending else "ASC"
    rows = ranged(df, order_by, partition_by)

    summed = dict.fromkeys([*totals, *sizes])
    per_range = rows.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__sum_{c}") for c in summed])
    partition = f"PARTITION BY {over} " if keys else ""
    before = f"({partition}ORDER BY __range {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = per_range.selectExpr(
        *[name(k) for k in keys],
        "__range",
        *[f"coalesce(sum({name(f'__sum_{c}')}) OVER {before}, 0) AS {name(f'__off_{c}')}" for c in totals],
        *[f"sum({name(f'__sum_{c}')}) OVER ({partition.strip()}) AS {name(f'__all_{c}')}" for c in sizes],
    )

    inside = ", ".join([*([over] if keys else []), "__range"])
    within = f"(PARTITION BY {inside} ORDER BY {order} {way} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return rows.join(offsets.hint("broadcast"), [*keys, "__range"]).selectExpr(
        *[name(c) for c in df.columns],
        *[f"{name(f'__off_{c}')} + sum({name(c)}) OVER {within} AS {name(out)}" for c, out in totals.items()],
        *[f"{name(f'__all_{c}')} AS {name(out)}" for c, out in sizes.items()],
    )


def number(col: str) -> str:
    """A column as double, with NaN as null, as SQL text."""
    return f"nanvl(CAST({name(col)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def quantile_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_SIZE) -> DataFrame:
    """(by, column, sketch): a mergeable sketch of the values of each column, missing ones and NaN left out.

    The sketches take a few kilobytes each, whatever the table, and can be
    stored: those of parts, such as days, merge into that of the whole (see
    ``merge_sketches``). The rank of a quantile read from a sketch of size
    ``k`` is off by at most about 2.3 / k^0.97 of the rows, with 99 % confidence.
    """
    pairs = ", ".join(f"{literal(c)}, {number(c)}" for c in cols)
    values = df.selectExpr(*[name(c) for c in by], f"stack({len(cols)}, {pairs}) AS (column, value)")
    return values.where("value IS NOT NULL").groupBy(*by, "column").agg(F.expr(f"kll_sketch_agg_double(value, {k}) AS sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, sketch) of the whole, from the sketches of its parts."""
    return sketches.groupBy(*by, "column").agg(F.expr("kll_merge_agg_double(sketch) AS sketch"))


def sketch_quantiles(sketches: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """The quantiles that the sketches give, next to their other columns."""
    others = [name(c) for c in sketches.columns if c != "sketch"]
    return sketches.selectExpr(*others, *[f"kll_sketch_get_quantile_double(sketch, {p}D) AS {name(out)}" for out, p in shares.items()])


def quantiles(df: DataFrame, cols: Sequence[str], shares: Mapping[str, float], exact: bool = True) -> DataFrame:
    """One row per column with its quantiles, linearly interpolated between order statistics.

    Exact quantiles are found by rank on the distinct values and their counts,
    which are written once, in ranges, when this is called. ``exact=False`` reads them from bounded sketches instead
    (see ``quantile_sketches``), which give values that occur.
    """
    if not exact:
        return sketch_quantiles(quantile_sketches(df, cols), shares)
    values = df.selectExpr(
        f"stack({len(cols)}, " + ", ".join(f"{literal(c)}, {number(c)}" for c in cols) + ") AS (column, value)"
    )
    grouped = values.where("value IS NOT NULL").groupBy("column", "value").agg(F.expr("count(*) AS n"))
    ranked = running_totals(grouped, "value", {"n": "__upto"}, partition_by="column", sizes={"n": "__size"})

    def statistic(index: str) -> str:
        return f"min(CASE WHEN __upto > {index} THEN value END)"

    places = {out: f"({p}D * (__size - 1))" for out, p in shares.items()}
    picked = ranked.groupBy("column").agg(
        F.expr("max(__size) AS __size"),
        *[F.expr(f"{statistic(f'floor({place})')} AS {name(f'__lo_{out}')}") for out, place in places.items()],
        *[F.expr(f"{statistic(f'ceil({place})')} AS {name(f'__hi_{out}')}") for out, place in places.items()],
    )
    return picked.selectExpr(
        "column",
        *[
            f"{lo} + ({hi} - {lo}) * ({place} - floor({place})) AS {name(out)}"
            for out, place in places.items()
            for lo, hi in [(name(f"__lo_{out}"), name(f"__hi_{out}"))]
        ],
    )
