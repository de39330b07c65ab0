"""Number parsing, safe ratios and the Wilson interval, as SQL expression text."""

from __future__ import annotations

from wardbook.functions.predicates import literal, name


def coerce_numeric(col: str) -> str:
    """The value as DOUBLE, null where the text is not a number. NaN counts as missing."""
    return f"nullif(try_cast({name(col)} AS DOUBLE), double('NaN'))"


def to_code(col: str, dtype: str = "int") -> str:
    """A number as an integer code; null where it is not whole, NaN or out of range."""
    number = name(col)
    return f"CASE WHEN {number} = floor({number}) THEN try_cast({number} AS {dtype}) END"


def to_identifier(col: str) -> str:
    """A text identifier as BIGINT without passing through DOUBLE, which is exact only to 2^53."""
    text = name(col)
    whole = f"regexp_extract({text}, '^\\\\s*([+-]?[0-9]+)[.]0*\\\\s*$', 1)"
    return f"coalesce(try_cast({text} AS BIGINT), try_cast({whole} AS BIGINT))"


def ratio(num: str, den: str) -> str:
    """num / den as DOUBLE, null when the denominator is 0."""
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def percent(num: str, den: str) -> str:
    return ratio(f"(({num}) * 100)", den)


def wilson_lower(cases: str, n: str, z: float = 1.96) -> str:
    """Lower Wilson bound of a proportion in percent, not below 0; null for n = 0."""
    centre, margin = _wilson(cases, n, z)
    return f"CASE WHEN {n} > 0 THEN greatest(0D, ({centre} - {margin}) * 100) END"


def wilson_upper(cases: str, n: str, z: float = 1.96) -> str:
    """Upper Wilson bound of a proportion in percent, not above 100; null for n = 0."""
    centre, margin = _wilson(cases, n, z)
    return f"CASE WHEN {n} > 0 THEN least(100D, ({centre} + {margin}) * 100) END"


def _wilson(cases: str, n: str, z: float) -> tuple[str, str]:
    share, spread = ratio(cases, n), ratio(literal(z * z), n)
    shrink = f"(1 + {spread})"
    centre = f"(({share} + {spread} / 2) / {shrink})"
    variance = f"({ratio(f'{share} * (1 - {share})', n)} + {ratio(spread, f'(4 * {n})')})"
    return centre, f"({literal(z)} * sqrt({variance}) / {shrink})"
