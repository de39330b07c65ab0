"""Turning numbers into labels, as SQL expression text."""

from __future__ import annotations

from collections.abc import Sequence

from wardbook.functions.predicates import literal, name


def right_closed(col: str, edges: Sequence[float], labels: Sequence) -> str:
    """Label of the interval (lo, hi] holding the value; null outside all of them."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need exactly one more edge than labels")
    value = name(col)
    return _first(
        (f"{value} > {literal(lo)} AND {value} <= {literal(hi)}", label)
        for lo, hi, label in zip(edges[:-1], edges[1:], labels)
    )


def left_closed(col: str, bands: Sequence[tuple]) -> str:
    """Label of the first band [lo, hi) holding the value; null outside all of them. A band whose hi is None has no upper end."""
    value = name(col)
    return _first((f"{value} >= {literal(lo)}" + ("" if hi is None else f" AND {value} < {literal(hi)}"), label) for lo, hi, label in bands)


def above(col: str, tiers: Sequence[tuple], default) -> str:
    """Label of the first (cut, label) with value > cut, cuts given in descending order.

    A known value below all cuts gets ``default``; null stays null.
    """
    value = name(col)
    cases = [(f"{value} > {literal(cut)}", label) for cut, label in tiers]
    return _first([*cases, (f"{value} IS NOT NULL", default)])


def up_to(col: str, cut: float, low, high) -> str:
    """``low`` for values up to and including the cut, ``high`` above it, null for null."""
    value = name(col)
    return _first([(f"{value} <= {literal(cut)}", low), (f"{value} > {literal(cut)}", high)])


def _first(cases) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {literal(label)}" for condition, label in cases) + " END"
