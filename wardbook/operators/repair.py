"""Fixing what validation finds, with a count of every fix.

A repair is a list of stages. Each stage holds fixes whose conditions are all
tested on the stage's input. The conditions become marker columns next to the
repaired ones, so the fixed rows and the counts of every stage come out of one
chain of projections, and the counts need a single pass over the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from wardbook.functions.literals import wide_to_long
from wardbook.functions.predicates import absent, all_of, equals, literal, name, recorded, when
from wardbook.operators import rules
from wardbook.operators.cleaning import Snap
from wardbook.operators.project import with_columns
from wardbook.operators.validate import wide_counts

MARK = "__fix_"


@dataclass(frozen=True)
class Fix:
    """Where ``condition`` holds, ``column`` becomes ``value`` and ``also`` shifts another column."""

    step: str
    name: str
    column: str
    condition: str
    value: str
    also: tuple[str, int] | None = None


def repair_codes(snaps: Sequence[Snap], total: str) -> list[Fix]:
    """Snap out-of-range codes and shift the total."""
    return [
        Fix("codes", f"{c} {bad} -> {good}", c, equals(c, bad), literal(good), (total, delta))
        for c, bad, good, delta in snaps
    ]


def repair_dependents(parents: Mapping[str, Sequence[str]]) -> list[Fix]:
    """Null the details recorded under an absent parent; counted per cell."""
    return [
        Fix("dependents", f"{child} without {parent}", child, all_of([absent(parent), recorded(child)]), "NULL")
        for parent, children in parents.items()
        for child in children
    ]


def repair_ratio(fine: str, coarse: str, factor: int) -> list[Fix]:
    """Null the fine column where it contradicts the coarse one."""
    broken = rules.consistent_ratio(fine, coarse, factor)
    return [Fix("ratio", broken.name, fine, broken.violated, "NULL")]


def repair_category(number: str, category: str, cut: float, below: int = 1, from_cut: int = 2) -> list[Fix]:
    """Derive a contradicting category from its number."""
    broken = rules.category_by_cut(number, category, cut, below, from_cut)
    value = when(f"{name(number)} < {literal(cut)}", literal(below), literal(from_cut))
    return [Fix("category", broken.name, category, broken.violated, value)]


def repair_implies(when_one: str, required: str | Sequence[str], mode: str) -> list[Fix]:
    """Mode "set" makes the one required column 1; mode "null" withdraws the implying value."""
    broken = rules.implies(when_one, required)
    if mode == "set":
        if not isinstance(required, str):
            raise ValueError("mode 'set' needs exactly one required column")
        return [Fix("implies", broken.name, required, broken.violated, "1")]
    if mode == "null":
        return [Fix("implies", broken.name, when_one, broken.violated, "NULL")]
    raise ValueError(f"unknown mode {mode!r}")


def repair(df: DataFrame, stages: Sequence[Sequence[Fix]]) -> tuple[DataFrame, DataFrame]:
    """Apply the stages in order; returns the fixed rows and the count of every fix."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    marked, fixes = df, [fix for stage in stages for fix in stage]
    number = 0
    for stage in stages:
        marks = [f"{MARK}{number + i}" for i in range(len(stage))]
        number += len(stage)
        marked = with_columns(marked, {mark: fix.condition for mark, fix in zip(marks, stage)})
        marked = with_columns(marked, _changes(types, stage, marks))
    return marked.select(*df.columns), _fix_counts(marked, fixes)


def _changes(types: Mapping[str, str], stage: Sequence[Fix], marks: Sequence[str]) -> dict[str, str]:
    changes: dict[str, str] = {}
    for fix, mark in zip(stage, marks):
        before = changes.get(fix.column, name(fix.column))
        changes[fix.column] = when(mark, f"CAST({fix.value} AS {types[fix.column]})", before)
        if fix.also:
            column, delta = fix.also
            before = changes.get(column, name(column))
            changes[column] = f"CAST({before} + {when(mark, literal(delta), '0')} AS {types[column]})"
    return changes


def _fix_counts(marked: DataFrame, fixes: Sequence[Fix]) -> DataFrame:
    counts = wide_counts(marked, [f"{MARK}{i}" for i in range(len(fixes))])
    entries = [_count_entry(f.step, f.name, f.column, f"c{i}") for i, f in enumerate(fixes)]
    entries.append(_count_entry("total", "all fixes", None, " + ".join(f"c{i}" for i in range(len(fixes)))))
    return wide_to_long(counts, entries)


def _count_entry(step: str, title: str, column: str | None, n: str) -> dict[str, str]:
    return {
        "step": literal(step),
        "fix": literal(title),
        "column": f"CAST({literal(column)} AS STRING)",
        "n_fixed": f"CAST({n} AS BIGINT)",
    }
