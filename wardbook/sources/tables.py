"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions.literals import literal_rows
from wardbook.functions.numbers import to_code, to_identifier
from wardbook.functions.predicates import name


def read_visits(
    spark: SparkSession,
    path: str,
    columns: Iterable[str],
    identifiers: Iterable[str] = (),
    fmt: str = "csv",
) -> DataFrame:
    """Read a table of codes with a fixed schema; blank or unreadable cells become null.

    CSV cells are read as DOUBLE, because an integer CSV schema would silently
    turn "4.0" into null; identifiers are read as text, because a DOUBLE is
    exact only to 2^53. Identifiers become BIGINT and all other columns INT.
    """
    columns, identifiers = list(columns), set(identifiers)
    if fmt == "csv":
        kinds = {c: T.StringType() if c in identifiers else T.DoubleType() for c in columns}
        schema = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "parquet":
        raw = raw.select([F.col(c).cast("string").alias(c) if c in identifiers else F.col(c) for c in columns])
    return raw.selectExpr(
        *[f"{to_identifier(c) if c in identifiers else to_code(c)} AS {name(c)}" for c in columns]
    )


def read_mapping(spark: SparkSession, path: str, source: str = "original", target: str = "new_names") -> dict[str, str]:
    """Read a two-column CSV of old and new column names as a dict; it has at most a row per column of a table."""
    pairs = (
        spark.read.option("header", True)
        .csv(path)
        .select(F.trim(source), F.trim(target))
        .collect()
    )
    mapping = {old: new for old, new in pairs}
    if len(mapping) != len(pairs) or len(set(mapping.values())) != len(pairs):
        raise ValueError(f"{path} does not map names one to one")
    return mapping


def default_output_path(folder: str, defaults: Mapping, chosen: Mapping, fmt: str = "parquet") -> str:
    """The cleaned table's path, or the perturbed one when any judgment call differs from its default."""
    changed = any(chosen.get(name, value) != value for name, value in defaults.items())
    return f"{folder.rstrip('/')}/{'cleaned_perturbed' if changed else 'cleaned'}.{fmt}"


def write_cleaned(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write the table as parquet or as CSV with a header, and return the path."""
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def schema_catalog(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and nullability. Reads no data."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return literal_rows(
        df.sparkSession,
        [("position", "int"), ("column", "string"), ("type", "string"), ("nullable", "boolean")],
        rows,
    )
