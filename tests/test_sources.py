"""Reading, writing and the study configuration."""

from __future__ import annotations

import pytest

from wardbook.functions.numbers import to_code
from wardbook.operators.project import label_codes, min_max_scale, rename_from_map
from wardbook.plans import head_trauma as study
from wardbook.plans.cleaning import JUDGMENT_DEFAULTS, CleanConfig
from wardbook.session import scratch_path
from wardbook.sources import default_output_path, read_mapping, read_visits, schema_catalog, write_cleaned
from wardbook.sources.visits import visits, visits_query


def test_codes_written_as_floats_are_read_as_integers(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,a,b\n9007199254740993,4.0,\n2.0,NaN,n/a\n,92,1.5\n")
    df = read_visits(spark, str(tmp_path / "in.csv"), ["id", "a", "b"], identifiers=["id"])
    assert [tuple(r) for r in df.collect()] == [(9007199254740993, 4, None), (2, None, None), (None, 92, None)]
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "int", "int"]


def test_parquet_source(spark, tmp_path):
    spark.sql("SELECT 5L AS id, 4.0D AS a").write.parquet(str(tmp_path / "p"))
    assert read_visits(spark, str(tmp_path / "p"), ["id", "a"], ["id"], fmt="parquet").collect() == [(5, 4)]
    with pytest.raises(ValueError):
        read_visits(spark, "nowhere", ["id"], fmt="xml")


def test_mapping_must_be_one_to_one(spark, tmp_path):
    (tmp_path / "m.csv").write_text("original,new_names\nA,alpha\nB,beta\n")
    assert read_mapping(spark, str(tmp_path / "m.csv")) == {"A": "alpha", "B": "beta"}
    (tmp_path / "bad.csv").write_text("original,new_names\nA,alpha\nB,alpha\n")
    with pytest.raises(ValueError):
        read_mapping(spark, str(tmp_path / "bad.csv"))


def test_output_path_tells_perturbed_runs_apart():
    assert default_output_path("data", JUDGMENT_DEFAULTS, vars(CleanConfig())) == "data/cleaned.parquet"
    changed = vars(CleanConfig().with_threshold(13))
    assert default_output_path("data/", JUDGMENT_DEFAULTS, changed, "csv") == "data/cleaned_perturbed.csv"


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "a")
    for fmt in ("parquet", "csv"):
        path = write_cleaned(df, str(tmp_path / fmt), fmt)
        assert read_visits(spark, path, ["a"], fmt=fmt).count() == 5
    with pytest.raises(ValueError):
        write_cleaned(df, str(tmp_path / "x"), "xml")


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_schema_catalog(spark):
    rows = schema_catalog(spark.sql("SELECT 1 AS a, 'x' AS b")).orderBy("position").collect()
    assert [(r["column"], r["type"]) for r in rows] == [("a", "int"), ("b", "string")]


def test_rename_refuses_clashes(spark):
    with pytest.raises(ValueError):
        rename_from_map(spark.sql("SELECT 1 AS a, 2 AS b"), {"a": "b"})
    assert rename_from_map(spark.sql("SELECT 1 AS a, 2 AS b"), {"a": "x", "zz": "y"}).columns == ["x", "b"]


def test_labels_are_quoted(spark):
    df = label_codes(spark.sql("SELECT explode(array(1, 2, NULL)) AS c"), "c", {1: "it's"}, "l", "none")
    assert [r["l"] for r in df.collect()] == ["it's", "none", "none"]


def test_scaling_equal_values_gives_null(spark):
    assert min_max_scale(spark.sql("SELECT 3 AS a"), "a", "s").first()["s"] is None


def test_whole_numbers_only_become_codes(spark):
    df = spark.sql("SELECT explode(array(4D, -1D, 3.7D, double('NaN'), 1e30D, NULL)) AS a")
    assert [r["c"] for r in df.selectExpr(f"{to_code('a')} AS c").collect()] == [4, -1, None, None, None, None]


def test_study_tables_are_complete():
    assert len(study.NAME_MAPPING) == 125 == len(set(study.NAME_MAPPING.values()))
    assert len(study.VALID_CODES) == 121 and len(study.FINDING_COLUMNS) == 18
    assert len(study.DEPENDENTS) == 13 and sum(map(len, study.DEPENDENTS.values())) == 59
    kinds = list(study.COLUMN_KINDS.values())
    assert (kinds.count("C"), kinds.count("B"), kinds.count("I")) == (23, 98, 4)


def test_visit_ids_beyond_any_overflow(spark):
    far = spark.sql("SELECT explode(array(0L, 1000003L, 9000000000000000L)) AS event_id")
    got = visits(spark, far).select("event_id", "GCSEye", "PosIntFinal").orderBy("event_id").collect()
    assert got[0][1:] == got[1][1:] and len(got) == 3
    assert "FROM events" in visits_query()
