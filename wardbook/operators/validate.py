"""Running rules over a table: counts in one pass, offending cells and rows on demand."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions.literals import literal_rows, wide_to_long
from wardbook.functions.numbers import percent
from wardbook.functions.predicates import all_of, any_of, count_if, equals, known, literal, name, negate
from wardbook.operators.rules import Rule
from wardbook.session import settle


def wide_counts(df: DataFrame, predicates: Iterable[str], prefix: str = "c") -> DataFrame:
    """One row with the number of rows meeting each predicate, from one pass over the table."""
    return df.agg(*[F.expr(f"{count_if(p)} AS {prefix}{i}") for i, p in enumerate(predicates)])


def validate(df: DataFrame, rules: Sequence[Rule], total: bool = True) -> DataFrame:
    """Violation count of every rule in one pass over the table, rules without violations included.

    The counts of all rules form one wide aggregate row, which is then spread
    into (check, rule, column, n_violations). ``total`` adds a closing row.
    """
    return _report(wide_counts(df, [r.violated for r in rules]), rules, total)


def observe_rules(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, Observation]:
    """The table with its rules counted by whatever job reads it next, such as the one that writes it."""
    seen = Observation()
    if not rules:
        return df, seen
    return df.observe(seen, *[F.expr(f"{count_if(r.violated)} AS c{i}") for i, r in enumerate(rules)]), seen


def observed_report(df: DataFrame, rules: Sequence[Rule], seen: Observation, total: bool = True) -> DataFrame:
    """The report of ``validate`` from counts that have been observed; it waits for the job that counts."""
    counts = seen.get if rules else {}
    row = df.sparkSession.range(1).selectExpr(*[f"{counts[f'c{i}']}L AS c{i}" for i in range(len(rules))] or ["id"])
    return _report(row, rules, total)


def _report(counts: DataFrame, rules: Sequence[Rule], total: bool) -> DataFrame:
    entries = [_report_entry(r.check, r.name, r.column, f"c{i}") for i, r in enumerate(rules)]
    if total:
        everything = " + ".join(f"c{i}" for i in range(len(rules))) or "0"
        entries.append(_report_entry("total", "all rules", None, everything))
    return wide_to_long(counts, entries)


def _report_entry(check: str, title: str, column: str | None, n: str) -> dict[str, str]:
    return {
        "check": literal(check),
        "rule": literal(title),
        "column": f"CAST({literal(column)} AS STRING)",
        "n_violations": f"CAST({n} AS BIGINT)",
    }


def violations(df: DataFrame, rules: Sequence[Rule], key: str | Sequence[str]) -> DataFrame:
    """One row per violated rule and record: key, check, rule, column and the cell's value.

    The value is a BIGINT if all the rules' columns are whole numbers, a DOUBLE
    if all are numbers, and else a STRING.
    """
    kind = _value_type(df, rules)
    keys = [key] if isinstance(key, str) else list(key)
    found = [
        f"CASE WHEN {r.violated} THEN named_struct('check', {literal(r.check)}, 'rule', {literal(r.name)},"
        f" 'column', {literal(r.column)}, 'value', CAST({name(r.column)} AS {kind})) END"
        for r in rules
    ]
    # Most rows violate nothing and are dropped before any array is built.
    return df.where(any_of(r.violated for r in rules)).selectExpr(
        *[name(k) for k in keys], f"inline(array_compact(array({', '.join(found)})))"
    )


def _value_type(df: DataFrame, rules: Sequence[Rule]) -> str:
    types = [df.schema[r.column].dataType for r in rules]
    if all(isinstance(t, T.IntegralType) for t in types):
        return "BIGINT"
    return "DOUBLE" if all(isinstance(t, T.NumericType) for t in types) else "STRING"


def validate_with_values(df: DataFrame, rules: Sequence[Rule], total: bool = True) -> tuple[DataFrame, DataFrame]:
    """The report of ``validate`` and the values behind it (see ``bad_values``), from one pass over the table.

    Violating cells are counted per rule and value, with map-side combining, and
    written once when this is called; the report sums the counts of a rule. So
    a rule that a third of the rows violate is a few rows before the shuffle,
    and the number of distinct values has no limit. At least one rule is needed.
    """
    kind = _value_type(df, rules)
    cells = ", ".join(
        f"CASE WHEN {r.violated} THEN named_struct('at', {i}, 'value', CAST({name(r.column)} AS {kind})) END"
        for i, r in enumerate(rules)
    )
    cells = df.where(any_of(r.violated for r in rules)).selectExpr(f"inline(array_compact(array({cells})))")
    counts = settle(cells.groupBy("at", "value").agg(F.count(F.lit(1)).alias("n")), "bad-values")
    sums = counts.agg(*[F.expr(f"coalesce(sum(CASE WHEN at = {i} THEN n END), 0L) AS c{i}") for i in range(len(rules))])
    listed = literal_rows(
        df.sparkSession,
        [("at", "int"), ("check", "string"), ("rule", "string"), ("column", "string")],
        [(i, r.check, r.name, r.column) for i, r in enumerate(rules)],
    )
    # One row per rule, so small whatever the table.
    values = counts.join(F.broadcast(listed), "at").select("check", "rule", "column", "value", "n")
    return _report(sums, rules, total), values


def bad_values(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The distinct violating values of each rule with their counts, one row per value."""
    return (
        violations(df, rules, key=[])
        .groupBy("check", "rule", "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ratio_agreement(df: DataFrame, fine: str, coarse: str, factor: int) -> DataFrame:
    """How often the fine column's whole units equal the coarse column, where both are known."""
    both = all_of([known(fine), known(coarse)])
    agrees = f"floor({name(fine)} / {factor}) = {name(coarse)}"
    counts = df.agg(
        F.expr(f"{count_if(both)} AS n_both"),
        F.expr(f"{count_if(agrees)} AS n_consistent"),
        F.expr(f"{count_if(f'NOT ({agrees})')} AS n_inconsistent"),
        F.expr(f"{count_if(negate(both))} AS n_incomplete"),
    )
    return counts.selectExpr("*", f"{percent('n_consistent', 'n_both')} AS pct_consistent")


def combo_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per combination of values; combinations with a null are left out."""
    return df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def findings_among(df: DataFrame, condition: str, findings: Sequence[str]) -> DataFrame:
    """The finding columns that are 1 in at least one row meeting the condition, with their counts."""
    counts = wide_counts(df.where(condition), [equals(c, 1) for c in findings])
    entries = [{"finding": literal(c), "n": f"c{i}"} for i, c in enumerate(findings)]
    return wide_to_long(counts, entries).where("n > 0")


def count_code(df: DataFrame, code: int, columns: Iterable[str] | None = None) -> DataFrame:
    """Cells holding a code, per numeric column and as a total over all of them."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    columns = list(columns)
    counts = wide_counts(df, [equals(c, code) for c in columns])
    entries = [{"column": literal(c), "n": f"c{i}"} for i, c in enumerate(columns)]
    entries.append({"column": "'all columns'", "n": " + ".join(f"c{i}" for i in range(len(columns)))})
    return wide_to_long(counts, entries)


def explain_zeros(df: DataFrame, col: str, companions: Mapping[str, int]) -> DataFrame:
    """How many rows with a 0 have each companion value, and how many lack at least one of them."""
    measures = {"zero": "true"}
    measures |= {f"{c} = {v}": equals(c, v) for c, v in companions.items()}
    measures["unexplained"] = any_of(negate(equals(c, v)) for c, v in companions.items())
    counts = wide_counts(df.where(equals(col, 0)), measures.values())
    return wide_to_long(counts, [{"measure": literal(m), "n": f"c{i}"} for i, m in enumerate(measures)])


def missing_pattern(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Distribution of the total among rows whose parts are all missing."""
    pattern = all_of([*[f"{name(p)} IS NULL" for p in parts], known(total)])
    return df.where(pattern).groupBy(total).agg(F.count(F.lit(1)).alias("n"))
