"""Deterministic corrections and imputations, each one projection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from wardbook.functions.predicates import absent, all_of, any_equals, certain, equals, known, literal, name, when
from wardbook.operators.project import with_columns

Snap = tuple[str, int, int, int]


def _typed(df: DataFrame, col: str, expr: str) -> str:
    """The expression cast to the column's own type, so that a correction never changes it."""
    return f"CAST({expr} AS {df.schema[col].dataType.simpleString()})"


def snap_codes(df: DataFrame, rules: Sequence[Snap], total: str) -> DataFrame:
    """Replace out-of-range codes and shift the total by each rule's amount.

    Every rule tests the value as it came in, so rules never chain, and all
    shifts apply to the same total.
    """
    changes = {}
    for column in dict.fromkeys(rule[0] for rule in rules):
        cases = " ".join(
            f"WHEN {equals(c, bad)} THEN {literal(good)}" for c, bad, good, _ in rules if c == column
        )
        changes[column] = _typed(df, column, f"CASE {cases} ELSE {name(column)} END")
    shifts = " + ".join(when(equals(column, bad), literal(delta), "0") for column, bad, _, delta in rules)
    return with_columns(df, {**changes, total: _typed(df, total, f"{name(total)} + {shifts}")})


def impute_from_total(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Fill the only missing part as the total minus the others."""

    def filled(part: str) -> str:
        others = [p for p in parts if p != part]
        due = all_of([f"{name(part)} IS NULL", known(total), *[known(p) for p in others]])
        value = " - ".join([name(total), *[name(p) for p in others]])
        return when(due, _typed(df, part, value), name(part))

    return with_columns(df, {part: filled(part) for part in parts})


def rederive_total(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Set the total to the sum of its parts where all are known; this also fills a missing total."""
    # The sum is null as soon as one part is.
    return with_columns(
        df, {total: f"coalesce({_typed(df, total, ' + '.join(name(p) for p in parts))}, {name(total)})"}
    )


def rederive_category(df: DataFrame, total: str, cuts: Sequence[tuple], out: str) -> DataFrame:
    """Set the category from the total by (lowest, highest, category) ranges; elsewhere it stays."""
    cases = " ".join(f"WHEN {in_range(total, lo, hi)} THEN {literal(category)}" for lo, hi, category in cuts)
    return with_columns(df, {out: _typed(df, out, f"CASE {cases} ELSE {name(out)} END")})


def in_range(col: str, lo: float | None, hi: float | None) -> str:
    """Inclusive range with None for an open end; a missing value is in no range."""
    tests = [known(col)]
    if lo is not None:
        tests.append(f"{name(col)} >= {literal(lo)}")
    if hi is not None:
        tests.append(f"{name(col)} <= {literal(hi)}")
    return all_of(tests)


def promote_flag(df: DataFrame, flag: str, any_of_columns: Iterable[str], qualifier: str) -> DataFrame:
    """Set a flag that is 0 or null to 1 where the qualifier and at least one finding are 1."""
    due = all_of([absent(flag), any_equals(any_of_columns, 1), equals(qualifier, 1)])
    return with_columns(df, {flag: when(due, _typed(df, flag, "1"), name(flag))})


def fill_when(df: DataFrame, col: str, condition: str, value) -> DataFrame:
    """Fill missing cells of a column where the condition holds."""
    due = all_of([f"{name(col)} IS NULL", certain(condition)])
    return with_columns(df, {col: when(due, _typed(df, col, literal(value)), name(col))})
