"""Risk ratios, comparing runs, and checking results against published bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions import binning
from wardbook.functions.literals import literal_rows, wide_to_long
from wardbook.functions.numbers import percent, ratio
from wardbook.functions.predicates import all_of, count_if, equals, literal, name
from wardbook.operators.project import with_columns


def risk_ratio(
    df: DataFrame,
    signs: Mapping[str, str],
    age: str,
    bands: Sequence[tuple],
    outcome: str,
    digits: int | None = None,
    count: str | None = None,
) -> DataFrame:
    """Outcome rate with a sign divided by the rate without it, per band and sign.

    0 stands for a ratio that cannot be formed: no rows on one side, or no case
    without the sign. ``n_pos`` and ``n_neg`` tell which. Bands without rows are listed too.
    A row stands for as many records as its column ``count`` says, if one is named.
    """
    parts = {
        "n_pos": lambda c: equals(c, 1),
        "n_neg": lambda c: equals(c, 0),
        "cases_pos": lambda c: all_of([equals(c, 1), equals(outcome, 1)]),
        "cases_neg": lambda c: all_of([equals(c, 0), equals(outcome, 1)]),
    }
    records = f"coalesce(sum(CASE WHEN {{}} THEN {name(count)} END), 0L)" if count else None
    counts = (
        with_columns(df, {"band": binning.left_closed(age, bands)})
        .where("band IS NOT NULL")
        .groupBy("band")
        .agg(
            *[
                F.expr(f"{records.format(test(c)) if records else count_if(test(c))} AS {p}_{i}")
                for i, c in enumerate(signs.values())
                for p, test in parts.items()
            ]
        )
    )
    grid = literal_rows(df.sparkSession, [("band", "string")], [(label,) for _, _, label in bands])
    entries = [
        {"sign": literal(sign)} | {p: f"coalesce({p}_{i}, 0)" for p in parts} for i, sign in enumerate(signs)
    ]
    table = wide_to_long(grid.join(counts, "band", "left"), entries, keep=["band"])
    value = f"coalesce({ratio(percent('cases_pos', 'n_pos'), percent('cases_neg', 'n_neg'))}, 0D)"
    return with_columns(table, {"risk_ratio": value if digits is None else f"round({value}, {digits})"})


def compare_runs(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same metric from two runs side by side with the change; rows found in one run only are kept."""
    runs = [
        table.select(*keys, F.lit(run).alias("__run"), F.col(value).alias("__value"))
        for run, table in (("before", before), ("after", after))
    ]
    return (
        runs[0]
        .unionByName(runs[1])
        .groupBy(*keys)
        .agg(*[F.expr(f"max(CASE WHEN __run = '{run}' THEN __value END) AS {run}") for run in ("before", "after")])
        .selectExpr("*", "after - before AS change")
    )


def reality_check(metrics: DataFrame, bounds: Sequence[tuple[str, float, float, float]]) -> DataFrame:
    """Whether each metric lies within its published bounds, widened by a tolerance."""
    published = literal_rows(
        metrics.sparkSession,
        [("metric", "string"), ("lower", "double"), ("upper", "double"), ("tolerance", "double")],
        bounds,
    )
    return metrics.join(published.hint("broadcast"), "metric").selectExpr(
        "*", "value BETWEEN lower - tolerance AND upper + tolerance AS passed"
    )
