"""Predicates as SQL expression text that is never null.

Rules over a hundred columns are assembled from these. Text is parsed by Spark
once per finished expression, which builds a wide plan many times faster than
composing it from Column objects one call at a time. A predicate goes wherever
``where`` or ``expr`` takes one.
"""

from __future__ import annotations

from collections.abc import Iterable


def name(col: str) -> str:
    """A column name quoted for SQL."""
    return "`" + col.replace("`", "``") + "`"


def literal(value) -> str:
    """A value written as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: Iterable) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def certain(predicate: str) -> str:
    """The predicate with null read as false."""
    return f"coalesce({predicate}, false)"


def negate(predicate: str) -> str:
    return f"(NOT {predicate})"


def equals(col: str, code) -> str:
    return f"({name(col)} <=> {literal(code)})"


def one_of(col: str, codes: Iterable) -> str:
    return certain(f"{name(col)} IN {_list(codes)}")


def not_one_of(col: str, codes: Iterable) -> str:
    """True for a known value outside the code set; null never matches."""
    return certain(f"{name(col)} NOT IN {_list(codes)}")


def known(col: str) -> str:
    return f"({name(col)} IS NOT NULL)"


def absent(col: str) -> str:
    """Null or 0: the condition the column stands for was not recorded as present."""
    return f"coalesce({name(col)} = 0, true)"


def recorded(col: str, zero_is_value: bool = False) -> str:
    """True where a detail was recorded. A 0 means "no" unless ``zero_is_value``."""
    return known(col) if zero_is_value else certain(f"{name(col)} <> 0")


def any_of(predicates: Iterable[str]) -> str:
    return "(" + (" OR ".join(predicates) or "false") + ")"


def all_of(predicates: Iterable[str]) -> str:
    return "(" + (" AND ".join(predicates) or "true") + ")"


def any_equals(cols: Iterable[str], code) -> str:
    return any_of(equals(c, code) for c in cols)


def when(condition: str, value: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {otherwise} END"


def count_if(predicate: str) -> str:
    return f"count_if({predicate})"
