"""Settled tables: what they leave on disk."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from wardbook.session import FREE_SHUFFLES, release, settle


def test_settle_restores_the_setting_and_release_deletes(spark):
    before = spark.conf.get(FREE_SHUFFLES)
    table = settle(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counts")
    other = settle(table.where("k > 2"), "some")
    assert spark.conf.get(FREE_SHUFFLES) == before and table.count() == 7
    release(table)
    assert not os.path.exists(table.settled_at.removeprefix("file:")) and other.count() == 4


def test_a_failed_write_restores_the_setting(spark):
    before = spark.conf.get(FREE_SHUFFLES)
    with pytest.raises(Exception):
        settle(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "failing")
    assert spark.conf.get(FREE_SHUFFLES) == before
