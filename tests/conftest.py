from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from wardbook import prepare

    return prepare(session)


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture
def rows(spark):
    """Build a table from (columns, rows) of nullable integers."""

    def build(columns: str, data):
        schema = ", ".join(f"{c} {'bigint' if c in ('rid', 'pid') else 'int'}" for c in columns.split())
        return spark.createDataFrame(data, schema)

    return build
