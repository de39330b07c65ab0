"""The query registry and the tables queries start from."""

from __future__ import annotations

from collections.abc import Callable
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

from wardbook.operators.project import null_codes, rename_from_map
from wardbook.plans import head_trauma as study
from wardbook.plans.cleaning import CleanConfig, clean
from wardbook.session import prepare, scratch_path
from wardbook.sources import write_cleaned
from wardbook.sources.visits import visits

KEY = "event_id"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle where SQL can express it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple, str] = {}
_STORING = RLock()


def stored(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application and read back as parquet.

    Analyses start from a saved table, as in practice: they prune columns and
    push filters into its scan instead of deriving it again.
    """
    key = (spark.sparkContext.applicationId, *key)
    with _STORING:
        if key not in _STORED:
            _STORED[key] = write_cleaned(build(), scratch_path(spark, str(key[1])))
    return spark.read.parquet(_STORED[key])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with raw column names and sentinel codes."""
    return stored(spark, ("visits", sf_dir), lambda: visits(spark, table(spark, sf_dir, "events")))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_from_map(raw(spark, sf_dir), study.NAME_MAPPING)


def nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with readable names and nulls, but none of the corrections."""
    return null_codes(named(spark, sf_dir), exclude=[KEY])


def clean_lazily(spark: SparkSession, sf_dir: str, **switches) -> DataFrame:
    """Cleaned visits as a plan; identifiers are filled only when ``order_by`` is given."""
    config = CleanConfig(validate=False, keep_codes=(KEY,), **switches)
    return clean(raw(spark, sf_dir), config).data


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved cleaned visits that profiling, analyses and models start from."""
    return stored(spark, ("cleaned", sf_dir), lambda: clean_lazily(spark, sf_dir))
