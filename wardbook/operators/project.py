"""Renaming, sentinel codes, types, labels, bins, flags and scaling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions import binning
from wardbook.functions.numbers import coerce_numeric
from wardbook.functions.predicates import any_of, literal, name, one_of

# Up to so many labels given as a dict stay in the plan as literals; more of them become a table.
LITERAL_LABELS = 1_000


def with_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Set or add columns given as SQL text, all computed from the input, in one projection."""
    kept = [f"{columns[c]} AS {name(c)}" if c in columns else name(c) for c in df.columns]
    return df.selectExpr(*kept, *[f"{expr} AS {name(c)}" for c, expr in columns.items() if c not in df.columns])


def rename_from_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename every column found in the mapping; other names pass through."""
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("renaming would give two columns the same name")
    return df.toDF(*names)


def null_codes(
    df: DataFrame,
    codes: Iterable[int] = (92,),
    columns: Iterable[str] | None = None,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """Turn sentinel codes into null in all numeric columns, or in the chosen ones."""
    listed = ", ".join(literal(c) for c in codes)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    chosen = (numeric if columns is None else set(columns)) - set(exclude)
    return with_columns(
        df, {c: f"CASE WHEN {name(c)} NOT IN ({listed}) THEN {name(c)} END" for c in df.columns if c in chosen}
    )


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns the table has.

    Spark has no category type: what a code column may hold is part of the rules, not of the type.
    """
    return with_columns(df, {c: f"CAST({name(c)} AS {types[c]})" for c in df.columns if c in types})


def coerce_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Parse the columns as numbers; text that is no number becomes null."""
    return with_columns(df, {c: coerce_numeric(c) for c in columns})


def label_codes(
    df: DataFrame, col: str, labels: Mapping | DataFrame, out: str, default: str | None = None
) -> DataFrame:
    """Add the label of a code; unmapped and null codes get ``default``.

    A dict is looked up in place, or made a table if it is long. A (code,
    label) table, one row per code, is left joined; Spark broadcasts it only if
    its size is below the broadcast threshold.
    """
    if not isinstance(labels, DataFrame) and len(labels) > LITERAL_LABELS:
        kind = T.StructType([df.schema[col], T.StructField("__label", T.StringType())])
        labels = df.sparkSession.createDataFrame(list(labels.items()), kind)
    if isinstance(labels, DataFrame):
        lookup = labels.toDF("__code", "__label")
        joined = df.join(lookup, df[col] == lookup["__code"], "left")
        return joined.selectExpr(
            *[name(c) for c in df.columns], f"coalesce(__label, {literal(default)}) AS {name(out)}"
        )
    cases = " ".join(f"WHEN {literal(code)} THEN {literal(label)}" for code, label in labels.items())
    return with_columns(df, {out: f"CASE {name(col)} {cases} ELSE {literal(default)} END"})


def bin_right(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence, out: str) -> DataFrame:
    """Add the label of the (lo, hi] bin; null outside the edges."""
    return with_columns(df, {out: binning.right_closed(col, edges, labels)})


def band_left(df: DataFrame, col: str, bands: Sequence[tuple], out: str) -> DataFrame:
    """Add the label of the [lo, hi) band; null outside the bands."""
    return with_columns(df, {out: binning.left_closed(col, bands)})


def tier(df: DataFrame, col: str, tiers: Sequence[tuple], default: str, out: str) -> DataFrame:
    """Add the label of the highest threshold the value exceeds."""
    return with_columns(df, {out: binning.above(col, tiers, default)})


def flag_at_least(df: DataFrame, col: str, threshold: float, out: str) -> DataFrame:
    """Add 1 where the value reaches the threshold, else 0; a missing value gives 0."""
    return with_columns(df, {out: f"CASE WHEN {name(col)} >= {literal(threshold)} THEN 1 ELSE 0 END"})


def derive_flags(df: DataFrame, flags: Mapping[str, Sequence[tuple[str, Sequence[int]]]]) -> DataFrame:
    """Add 0/1 flags: 1 where any of the flag's columns holds one of its codes, missing counts as no."""
    return with_columns(
        df, {flag: f"CAST({any_of(one_of(c, codes) for c, codes in tests)} AS INT)" for flag, tests in flags.items()}
    )


def recode_binary(df: DataFrame, col: str, one: int, out: str) -> DataFrame:
    """Add 1 where the column holds the code ``one``, else 0."""
    return derive_flags(df, {out: [(col, [one])]})


def min_max_scale(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add the value scaled to 0..1 over the whole result; null when all values are equal."""
    bounds = df.selectExpr(
        f"named_struct('lo', CAST(min({name(col)}) AS DOUBLE), 'hi', CAST(max({name(col)}) AS DOUBLE))"
    ).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    return df.withColumn(out, F.try_divide(F.col(col).cast("double") - lo, hi - lo))
