"""Small tables given in code, and turning one wide row into many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from wardbook.functions.predicates import literal, name


def literal_rows(spark: SparkSession, schema: Sequence[tuple[str, str]], rows: Sequence[Sequence]) -> DataFrame:
    """A small table written in code. It stays in the plan as literals: no Python worker, no job."""
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{name(n)} {t}" for n, t in schema))
    return wide_to_long(
        spark.range(1),
        [{n: f"CAST({literal(value)} AS {t})" for (n, t), value in zip(schema, row)} for row in rows],
    )


def wide_to_long(row: DataFrame, entries: Sequence[Mapping[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Spread each wide aggregate row into one row per entry, keeping the ``keep`` columns.

    An entry maps output columns to SQL expressions over the wide row.
    """
    structs = [
        "named_struct(" + ", ".join(f"{literal(column)}, {expr}" for column, expr in entry.items()) + ")"
        for entry in entries
    ]
    return row.selectExpr(*[name(c) for c in keep], f"inline(array({', '.join(structs)}))")
