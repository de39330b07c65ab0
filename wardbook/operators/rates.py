"""Outcome rates and code shares by group.

Every table here comes from one hash aggregate over the rows. What follows it
works on counts per code and group. Where those counts are used several times
(shares, gaps, matrices) they are written once when the operator is called, so
that the rows are scanned once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions import binning
from wardbook.functions.literals import literal_rows, wide_to_long
from wardbook.functions.numbers import percent, ratio, wilson_lower, wilson_upper
from wardbook.functions.predicates import all_of, certain, count_if, equals, known, literal, name
from wardbook.operators.project import with_columns
from wardbook.operators.validate import wide_counts
from wardbook.session import settle


def _rate(denom: str, cases: str = "cases", n: str = "n", n_known: str = "n_known") -> str:
    """Cases in percent of known outcomes (0 if none is known) or of all rows."""
    if denom == "known":
        return f"coalesce({percent(cases, n_known)}, 0D)"
    if denom == "all":
        return percent(cases, n)
    raise ValueError(f"unknown denominator {denom!r}")


def _outcome_counts(outcome: str) -> list:
    return [
        F.expr("count(*) AS n"),
        F.expr(f"count({name(outcome)}) AS n_known"),
        F.expr(f"{count_if(equals(outcome, 1))} AS cases"),
    ]


def rate_table(df: DataFrame, factor: str, outcome: str, denom: str = "known") -> DataFrame:
    """Outcome rate in percent per level of a factor, highest first.

    ``denom`` is "known" to divide by rows with a known outcome, "all" to divide by all rows.
    """
    counts = df.where(known(factor)).groupBy(factor).agg(*_outcome_counts(outcome))
    return counts.selectExpr("*", f"{_rate(denom)} AS rate").orderBy(F.desc("rate"), F.asc(factor))


def rate_table_ci(df: DataFrame, factor: str, outcome: str, denom: str = "all", z: float = 1.96) -> DataFrame:
    """Rate table with the Wilson interval of each rate in percent."""
    size = "n_known" if denom == "known" else "n"
    return with_columns(
        rate_table(df, factor, outcome, denom),
        {"ci_lower": wilson_lower("cases", size, z), "ci_upper": wilson_upper("cases", size, z)},
    )


def overall_rate(df: DataFrame, outcome: str, where: str = "true", denom: str = "known") -> DataFrame:
    """Outcome rate of a whole population as one row."""
    return df.where(where).agg(*_outcome_counts(outcome)).selectExpr("*", f"{_rate(denom)} AS rate")


def _top_codes(cells: DataFrame, code: str, k: int) -> DataFrame:
    """(code, rank) of the k most frequent codes, from counts per code."""
    totals = cells.where(known(code)).groupBy(code).agg(F.expr("sum(n) AS __total"))
    top = totals.orderBy(F.desc("__total"), F.asc(code)).limit(k)
    # The window sees k rows.
    return top.selectExpr(name(code), f"row_number() OVER (ORDER BY __total DESC, {name(code)}) AS code_rank")


def _dense_cells(
    cells: DataFrame, key: str, levels: Sequence, code: str, k: int, sums: Sequence[str]
) -> DataFrame:
    """Every combination of top code and key level with its counts, 0 where no row fell."""
    listed = ", ".join(literal(v) for v in levels)
    grid = _top_codes(cells, code, k).selectExpr("*", f"explode(array({listed})) AS {name(key)}")
    joined = grid.join(cells.select(key, code, *sums), [key, code], "left")
    return with_columns(joined, {c: f"coalesce({name(c)}, 0)" for c in sums})


def share_matrix(df: DataFrame, group: str, code: str, k: int, groups: Sequence) -> DataFrame:
    """Share in percent of each of the k most frequent codes within each group; all rows of a group count.

    Codes are ranked over the whole table. Groups without rows get 0.
    """
    cells = settle(df.groupBy(group, code).agg(F.expr("count(*) AS n")), "share-cells")
    sizes = cells.groupBy(group).agg(F.expr("sum(n) AS group_n"))
    dense = _dense_cells(cells, group, groups, code, k, ["n"])
    return dense.join(sizes, group, "left").selectExpr(
        name(group),
        name(code),
        "code_rank",
        "n",
        "coalesce(group_n, 0) AS group_n",
        f"coalesce({percent('n', 'group_n')}, 0D) AS share",
    )


def share_by_grid(df: DataFrame, key: str, lo: int, hi: int, code: str, k: int) -> DataFrame:
    """The share matrix over every integer from lo to hi."""
    return share_matrix(df, key, code, k, range(lo, hi + 1))


def dominant(df: DataFrame, group: str, code: str) -> DataFrame:
    """The most frequent code of each group (smaller code on a tie) and its share of all rows of the group."""
    cells = df.where(known(group)).groupBy(group, code).agg(F.expr("count(*) AS n"))
    best = f"min(CASE WHEN {known(code)} THEN named_struct('minus_n', -n, 'code', {name(code)}) END) AS best"
    per_group = cells.groupBy(group).agg(F.expr(best), F.expr("sum(n) AS group_n")).where("best IS NOT NULL")
    return per_group.selectExpr(
        name(group),
        f"best.code AS {name(code)}",
        "-best.minus_n AS n",
        "group_n",
        f"{percent('-best.minus_n', 'group_n')} AS share",
    )


def ordered_rate(df: DataFrame, where: str, level: str, outcome: str) -> DataFrame:
    """Outcome rate of all rows per level among selected rows, and its ratio to the level before."""
    counts = df.where(all_of([certain(where), known(level)])).groupBy(level).agg(*_outcome_counts(outcome))
    rates = counts.selectExpr("*", f"{_rate('all')} AS rate")
    # The window sees one row per level of a code column.
    return rates.selectExpr("*", f"try_divide(rate, lag(rate) OVER (ORDER BY {name(level)})) AS ratio_to_previous")


def gap_table(df: DataFrame, side: str, sides: tuple, group: str, groups: Sequence, code: str, k: int) -> DataFrame:
    """Code shares of two sides within each group, and their difference (first minus second)."""
    ends = dict(zip(("first", "second"), sides))
    counted = df.groupBy(group, code).agg(
        F.expr("count(*) AS n"), *[F.expr(f"{count_if(equals(side, v))} AS n_{end}") for end, v in ends.items()]
    )
    cells = settle(counted, "gap-cells")
    sizes = cells.groupBy(group).agg(*[F.expr(f"sum(n_{end}) AS group_n_{end}") for end in ends])
    dense = _dense_cells(cells, group, groups, code, k, [f"n_{end}" for end in ends])
    shares = dense.join(sizes, group, "left").selectExpr(
        name(group),
        name(code),
        "code_rank",
        *[f"coalesce(group_n_{end}, 0) AS group_n_{end}" for end in ends],
        *[f"coalesce({percent(f'n_{end}', f'group_n_{end}')}, 0D) AS share_{end}" for end in ends],
    )
    return shares.selectExpr("*", "share_first - share_second AS gap")


def largest_gap(gaps: DataFrame, group: str, value) -> DataFrame:
    """The code with the largest absolute gap in one group; the more frequent code on a tie."""
    return gaps.where(equals(group, value)).orderBy(F.desc(F.abs("gap")), "code_rank").limit(1)


def rate_matrix(
    df: DataFrame, row: str, col: str, outcome: str, cols: Sequence, k: int | None, min_n: int = 10, all_levels: bool = False
) -> DataFrame:
    """Outcome rate of each top-k row code and column level; cells below ``min_n`` rows keep only their size.

    With ``k`` None all row codes are taken, and with ``all_levels`` the column
    levels found besides ``cols``, which the driver lists. Missing codes and
    levels are in no cell.
    """
    cells = settle(df.groupBy(row, col).agg(*_outcome_counts(outcome)), "rate-cells")
    if k is None:
        k = max(1, cells.select(row).distinct().count())
    if all_levels:
        found = [r[0] for r in cells.where(known(col)).select(col).distinct().collect()]
        cols = [*cols, *sorted(set(found) - set(cols))]
    dense = _dense_cells(cells, col, cols, row, k, ["n", "n_known", "cases"])
    return dense.selectExpr(
        name(row), name(col), "code_rank", "n", f"CASE WHEN n >= {min_n} THEN {_rate('known')} END AS rate"
    )


def widen_matrix(matrix: DataFrame, row: str, col: str, cols: Sequence, value: str) -> DataFrame:
    """One column per column level of a matrix in long form."""
    return matrix.groupBy(row).pivot(col, list(cols)).agg(F.max(value))


def hot_cells(matrix: DataFrame, cut: float) -> DataFrame:
    """Cells of a rate matrix with a rate above the cut, highest first."""
    return matrix.where(f"rate > {literal(cut)}").orderBy(F.desc("rate"))


def rate_by_score(
    df: DataFrame, score: str, outcome: str, lo: int, hi: int, cut: float, low: str, high: str
) -> DataFrame:
    """Outcome rate per score between lo and hi, labelled by whether the score is up to the cut."""
    table = rate_table(df.where(f"{name(score)} BETWEEN {lo} AND {hi}"), score, outcome)
    return with_columns(table, {"risk": binning.up_to(score, cut, low, high)})


def score_gap(table: DataFrame, score: str, first: int, second: int) -> DataFrame:
    """Absolute rate difference between two scores of a rate table."""
    rates = {end: f"max(CASE WHEN {equals(score, v)} THEN rate END)" for end, v in (("first", first), ("second", second))}
    return table.selectExpr(
        *[f"{rate} AS rate_{end}" for end, rate in rates.items()], f"abs({rates['first']} - {rates['second']}) AS gap"
    )


def outcome_compare(df: DataFrame, by: str, levels: tuple, outcomes: Sequence[str]) -> DataFrame:
    """Rates of several outcomes in two categories, one row per outcome, from one wide aggregate."""
    tests = [
        all_of([equals(by, level), test])
        for o in outcomes
        for level in levels
        for test in (known(o), equals(o, 1))
    ]
    entries = [
        {
            "outcome": literal(o),
            "rate_first": _rate("known", cases=f"c{4 * i + 1}", n_known=f"c{4 * i}"),
            "rate_second": _rate("known", cases=f"c{4 * i + 3}", n_known=f"c{4 * i + 2}"),
        }
        for i, o in enumerate(outcomes)
    ]
    return wide_to_long(wide_counts(df, tests), entries)


def predictor_rates(
    df: DataFrame, predictors: Mapping[str, str], group: str, groups: tuple, outcome: str
) -> DataFrame:
    """Outcome rate where each predictor is present, in two groups, with the difference.

    A predictor maps its name to a presence predicate. A group in which it never occurs gets 0.
    """
    tests = [
        all_of([equals(group, level), certain(present), test])
        for present in predictors.values()
        for level in groups
        for test in ("true", known(outcome), equals(outcome, 1))
    ]
    entries = []
    for i, title in enumerate(predictors):
        n1, known1, cases1, n2, known2, cases2 = (f"c{6 * i + j}" for j in range(6))
        first, second = _rate("known", cases1, n_known=known1), _rate("known", cases2, n_known=known2)
        entries.append(
            {
                "predictor": literal(title),
                "n_first": n1,
                "n_second": n2,
                "rate_first": first,
                "rate_second": second,
                "difference": f"{first} - {second}",
            }
        )
    return wide_to_long(wide_counts(df, tests), entries)


def dimension_rates(df: DataFrame, dims: Mapping[str, Mapping[int, str]], num: str, den: str) -> DataFrame:
    """Two rates and their ratio for every labelled level of several dimensions, from one GROUPING SETS pass."""
    cols = list(dims)
    counts = df.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
        F.expr("grouping_id() AS __set"),
        F.expr("count(*) AS n"),
        *[
            F.expr(f"{expr} AS {side}_{kind}")
            for side, c in (("num", num), ("den", den))
            for kind, expr in (("known", f"count({name(c)})"), ("cases", count_if(equals(c, 1))))
        ],
    )
    # In a grouping id the bit of the one column that is grouped by is 0.
    full = 2 ** len(cols) - 1
    which = {c: full - 2 ** (len(cols) - 1 - i) for i, c in enumerate(cols)}
    dimension = " ".join(f"WHEN {which[c]} THEN {literal(c)}" for c in cols)
    level = " ".join(f"WHEN {which[c]} THEN CAST({name(c)} AS INT)" for c in cols)
    rates = counts.selectExpr(
        f"CASE __set {dimension} END AS dimension",
        f"CASE __set {level} END AS level",
        "n",
        *[f"{_rate('known', f'{s}_cases', n_known=f'{s}_known')} AS {s}_rate" for s in ("num", "den")],
    )
    labels = literal_rows(
        df.sparkSession,
        [("dimension", "string"), ("level", "int"), ("label", "string")],
        [(c, code, label) for c in cols for code, label in dims[c].items()],
    )
    return rates.join(labels.hint("broadcast"), ["dimension", "level"]).selectExpr(
        "*", f"coalesce({ratio('num_rate', 'den_rate')}, 0D) AS ratio"
    )
