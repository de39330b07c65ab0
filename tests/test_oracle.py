"""Every query with an oracle gives the same rows as DuckDB; the others give rows."""

from __future__ import annotations

import pytest
from compare import connect, differences

from catalog import ORACLE_SQL, QUERIES

# Rows-only queries are exercised with their numbers in test_models.
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE_SQL))


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(name, spark, sf_dir, duck):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name]) == []


def test_only_learned_models_lack_an_oracle():
    assert all(name.startswith(("logistic_", "forest_", "model_")) for name in ROWS_ONLY)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
