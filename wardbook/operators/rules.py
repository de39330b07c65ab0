"""Validation rules: each is a predicate that is true for a violating row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from wardbook.functions.predicates import (
    absent,
    all_of,
    any_equals,
    any_of,
    certain,
    equals,
    literal,
    name,
    negate,
    not_one_of,
    recorded,
)
from wardbook.operators.cleaning import in_range


@dataclass(frozen=True)
class Rule:
    """A named check. ``column`` is the one whose cell is shown for a violation."""

    check: str
    name: str
    column: str
    violated: str


def rule(title: str, violated: str, column: str, check: str = "custom") -> Rule:
    """A rule from any SQL predicate; null does not violate it."""
    return Rule(check, title, column, certain(violated))


def valid_codes(codes: Mapping[str, Sequence[int]]) -> list[Rule]:
    """One rule per column: a known value must be one of the listed codes."""
    return [Rule("codes", f"{c} in list", c, not_one_of(c, allowed)) for c, allowed in codes.items()]


def dependents(parents: Mapping[str, Sequence[str]], zero_is_value: bool = False) -> list[Rule]:
    """One rule per parent: nothing may be recorded in a detail column while the parent is 0 or null."""
    return [
        Rule(
            "dependents",
            f"{parent} absent",
            parent,
            all_of([absent(parent), any_of(recorded(c, zero_is_value) for c in children)]),
        )
        for parent, children in parents.items()
    ]


def consistent_ratio(fine: str, coarse: str, factor: int) -> Rule:
    """The whole units of the fine column must equal the coarse column where both are known."""
    return rule(f"{fine} // {factor} = {coarse}", f"floor({name(fine)} / {factor}) <> {name(coarse)}", fine, "ratio")


def within_unit(fine: str, coarse: str, factor: int) -> Rule:
    """The same check from the coarse side: the fine value lies inside its unit."""
    start = f"{name(coarse)} * {factor}"
    outside = f"{name(fine)} < {start} OR {name(fine)} >= {start} + {factor}"
    return rule(f"{fine} within {coarse}", outside, fine, "ratio")


def category_by_cut(number: str, category: str, cut: float, below: int = 1, from_cut: int = 2) -> Rule:
    """The category must follow from the number where both are known."""
    expected = f"CASE WHEN {name(number)} < {literal(cut)} THEN {below} WHEN {name(number)} IS NOT NULL THEN {from_cut} END"
    return rule(f"{category} by {number}", f"{name(category)} <> {expected}", category, "category")


def category_by_ranges(number: str, category: str, ranges: Sequence[tuple]) -> Rule:
    """The category must be the one of the (lowest, highest, category) range holding the number."""
    cases = " ".join(f"WHEN {in_range(number, lo, hi)} THEN {code}" for lo, hi, code in ranges)
    return rule(f"{category} by {number}", f"{name(category)} <> CASE {cases} END", category, "category")


def implies(when_one: str, required: str | Iterable[str]) -> Rule:
    """Where the first column is 1 every required column must be 1; null does not satisfy it."""
    needed = [required] if isinstance(required, str) else list(required)
    violated = all_of([equals(when_one, 1), any_of(negate(equals(c, 1)) for c in needed)])
    return Rule("implies", f"{when_one} needs {' and '.join(needed)}", when_one, violated)


def flag_covers(flag: str, findings: Sequence[str]) -> Rule:
    """The flag may not be 0 or null while any finding is 1."""
    return Rule("findings", f"{flag} covers findings", flag, all_of([absent(flag), any_equals(findings, 1)]))


def at_most(column: str, bound: float) -> Rule:
    return rule(f"{column} <= {bound}", f"{name(column)} > {literal(bound)}", column, "bound")


def not_zero(columns: Iterable[str]) -> list[Rule]:
    """One rule per column in which 0 has no meaning."""
    return [Rule("zeros", f"{c} not 0", c, equals(c, 0)) for c in columns]
