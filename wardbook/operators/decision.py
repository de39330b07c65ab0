"""Branching decision rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from wardbook.functions.predicates import any_of, equals, literal, name
from wardbook.operators.project import with_columns

Branches = Mapping[int, Sequence[tuple[str, int]]]


def apply_rule(df: DataFrame, group: str, branches: Branches, out: str) -> DataFrame:
    """Add 1 where any test of the row's branch is met, else 0; null for a group without a branch.

    A branch is a list of (column, code) tests.
    """
    cases = " ".join(
        f"WHEN {literal(value)} THEN CAST({any_of(equals(c, code) for c, code in tests)} AS INT)"
        for value, tests in branches.items()
    )
    return with_columns(df, {out: f"CASE {name(group)} {cases} END"})


def rule_reason(df: DataFrame, group: str, branches: Branches, out: str) -> DataFrame:
    """Add the name of the first test met, in the order in which the branch asks them."""

    def first(tests) -> str:
        return "CASE " + " ".join(f"WHEN {equals(c, code)} THEN {literal(c)}" for c, code in tests) + " END"

    cases = " ".join(f"WHEN {literal(value)} THEN {first(tests)}" for value, tests in branches.items())
    return with_columns(df, {out: f"CASE {name(group)} {cases} END"})


def predict_at(df: DataFrame, score: str, threshold: float, out: str) -> DataFrame:
    """Add 1 where the score reaches the threshold, else 0; null without a score."""
    return with_columns(df, {out: f"CAST({name(score)} >= {literal(threshold)} AS INT)"})
