"""Reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, clean_lazily, named, query, raw
from catalog.oracle import CODED, COLUMNS, cleaned_sql, count_if, named_sql, raw_sql, union_rows
from wardbook.functions.literals import literal_rows
from wardbook.operators.profile import missing_profile
from wardbook.operators.project import rename_from_map
from wardbook.plans import head_trauma as study
from wardbook.session import scratch_path
from wardbook.sources import read_mapping, read_visits, schema_catalog, write_cleaned

IDS = [KEY, "patient_number"]
TYPED = ", ".join(c if c in IDS else f"CAST({c} AS INTEGER) AS {c}" for c in COLUMNS)


@query("read_coded_csv", named_sql(f"SELECT {TYPED} FROM named"))
def read_coded_csv(spark, sf_dir):
    """Codes written as "4.0" with blanks for missing cells come back as integers and nulls."""
    visits = named(spark, sf_dir)
    as_floats = visits.select([F.col(c) if c == KEY else F.col(c).cast("double").alias(c) for c in visits.columns])
    path = write_cleaned(as_floats, scratch_path(spark, "coded-csv"), fmt="csv")
    return read_visits(spark, path, visits.columns, identifiers=IDS)


@query(
    "read_name_mapping",
    raw_sql(
        "SELECT event_id, PatNum AS patient_number, GCSEye AS gcs_eye_score, PosIntFinal AS has_clinically_important_tbi FROM visits"
    ),
)
def read_name_mapping(spark, sf_dir):
    """A mapping written as a two-column CSV is read back and renames the visits."""
    rows = literal_rows(spark, [("original", "string"), ("new_names", "string")], list(study.NAME_MAPPING.items()))
    path = write_cleaned(rows, scratch_path(spark, "mapping"), fmt="csv")
    renamed = rename_from_map(raw(spark, sf_dir), read_mapping(spark, path))
    return renamed.select(KEY, "patient_number", "gcs_eye_score", study.OUTCOME)


@query("write_cleaned_parquet", cleaned_sql("SELECT * FROM cleaned"))
def write_cleaned_parquet(spark, sf_dir):
    path = write_cleaned(clean_lazily(spark, sf_dir), scratch_path(spark, "cleaned"))
    return spark.read.parquet(path)


@query(
    "column_catalogue",
    named_sql(
        union_rows(
            [
                {'"position"': str(i), '"column"': f"'{c}'", "n_missing": count_if(f"{c} IS NULL")}
                for i, c in enumerate([KEY, *CODED], 1)
            ],
            "named",
        )
    ),
)
def column_catalogue(spark, sf_dir):
    """Position and name of every column with its number of missing cells."""
    visits = named(spark, sf_dir)
    catalogue = schema_catalog(visits).join(missing_profile(visits), "column", "left")
    return catalogue.select("position", "column", F.coalesce("n_missing", F.lit(0)).alias("n_missing"))
