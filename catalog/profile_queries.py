"""Profiling aggregations."""

from __future__ import annotations

from catalog.base import KEY, cleaned, nulled, query, table
from catalog.oracle import CODED, T, cleaned_sql, count_if, div, nulled_sql, pct, union_rows
from wardbook.operators import profile, ranking
from wardbook.plans import head_trauma as study


@query(
    "missing_profile",
    nulled_sql(
        "SELECT * FROM missing WHERE n_missing > 0",
        missing=union_rows(
            [
                {
                    '"column"': f"'{c}'",
                    "n_missing": count_if(f"{c} IS NULL"),
                    "pct_missing": pct(count_if(f"{c} IS NULL"), "count(*)"),
                }
                for c in [KEY, *CODED]
            ],
            "nulled",
        ),
    ),
)
def missing_profile(spark, sf_dir):
    return profile.missing_profile(nulled(spark, sf_dir))


def _describe_sql(columns, source: str) -> str:
    return union_rows(
        [
            {
                '"column"': f"'{c}'",
                '"count"': f"count({c})",
                "mean": f"avg({c})",
                "std": f"round(stddev_samp({c}), 6)",
                '"min"': f"CAST(min({c}) AS DOUBLE)",
                "q1": f"quantile_cont(CAST({c} AS DOUBLE), 0.25)",
                "median": f"quantile_cont(CAST({c} AS DOUBLE), 0.5)",
                "q3": f"quantile_cont(CAST({c} AS DOUBLE), 0.75)",
                '"max"': f"CAST(max({c}) AS DOUBLE)",
            }
            for c in columns
        ],
        source,
    )


def _rounded(df):
    """The order of additions differs between engines, so the deviation is compared to six digits."""
    from pyspark.sql import functions as F

    return df.withColumn("std", F.round("std", 6))


AGES = [T, "patient_age_years", "patient_age_months"]


@query("describe_ages", cleaned_sql(_describe_sql(AGES, "cleaned")))
def describe_ages(spark, sf_dir):
    return _rounded(profile.describe(cleaned(spark, sf_dir), AGES))


@query(
    "describe_prices",
    _describe_sql(["l_extendedprice", "l_quantity"], "lineitem").replace("avg(l_extendedprice)", "round(avg(l_extendedprice), 4)"),
)
def describe_prices(spark, sf_dir):
    from pyspark.sql import functions as F

    table_ = _rounded(profile.describe(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"]))
    return table_.withColumn("mean", F.when(F.col("column") == "l_extendedprice", F.round("mean", 4)).otherwise(F.col("mean")))


SKETCHED, RANK_ERROR = ["l_extendedprice", "l_quantity"], 0.002


@query(
    "price_quantiles_from_sketches",
    union_rows(
        [{'"column"': f"'{c}'", "quantile": f"'{q}'", "n": f"count({c})", "within_rank_error": "true"} for c in SKETCHED for q in profile.QUARTILES],
        "lineitem",
    ),
)
def price_quantiles_from_sketches(spark, sf_dir):
    """Quartiles from sketches per return flag, merged; their true ranks are counted in the table."""
    from pyspark.sql import functions as F

    lines = table(spark, sf_dir, "lineitem")
    merged = ranking.merge_sketches(ranking.quantile_sketches(lines, SKETCHED, by=["l_returnflag"]))
    found = ranking.sketch_quantiles(merged, profile.QUARTILES)
    cuts = ", ".join(f"'{q}', {p}D, {q}" for q, p in profile.QUARTILES.items())
    cuts = found.selectExpr("column", f"stack({len(profile.QUARTILES)}, {cuts}) AS (quantile, share, cut)")
    values = lines.selectExpr("stack(2, " + ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in SKETCHED) + ") AS (column, value)")
    # Six cuts.
    ranks = values.where("value IS NOT NULL").join(F.broadcast(cuts), "column").groupBy("column", "quantile", "share")
    ranks = ranks.agg(F.expr("count(*) AS n"), F.expr("count_if(value < cut) / count(*) AS below"), F.expr("count_if(value <= cut) / count(*) AS upto"))
    return ranks.selectExpr("column", "quantile", "n", f"below <= share + {RANK_ERROR} AND upto >= share - {RANK_ERROR} AS within_rank_error")


def _counts_sql(col: str, source: str, where: str) -> str:
    return (
        f"SELECT {col}, count(*) AS n, {div('count(*)', f'(SELECT count(*) FROM {source} WHERE {where})')} AS share"
        f" FROM {source} WHERE {where} GROUP BY {col}"
    )


@query("count_total_scores", cleaned_sql(_counts_sql(T, "cleaned", f"{T} IS NOT NULL")))
def count_total_scores(spark, sf_dir):
    return profile.value_counts(cleaned(spark, sf_dir), T)


@query("count_outcomes_with_missing", cleaned_sql(_counts_sql(study.OUTCOME, "cleaned", "true")))
def count_outcomes_with_missing(spark, sf_dir):
    return profile.value_counts(cleaned(spark, sf_dir), study.OUTCOME, dropna=False)


@query("count_return_flags", _counts_sql("l_returnflag", "lineitem", "true"))
def count_return_flags(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "lineitem"), "l_returnflag")


MANY = ["injury_mechanism", "injury_mechanism_severity", "patient_gender", "patient_race", "patient_ethnicity", "gcs_category"]


@query(
    "count_many_columns",
    cleaned_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", CAST({c} AS BIGINT) AS "value", count(*) AS n,
            {div('count(*)', '(SELECT count(*) FROM cleaned)')} AS share FROM cleaned GROUP BY {c}"""
            for c in MANY
        )
    ),
)
def count_many_columns(spark, sf_dir):
    return profile.value_counts_many(cleaned(spark, sf_dir), MANY)


def _histogram_sql(col: str, source: str, bins: int) -> str:
    return f"""SELECT CAST(b AS INTEGER) AS bin, lo + b * ((hi - lo) / {bins}) AS lower, lo + (b + 1) * ((hi - lo) / {bins}) AS upper,
    (SELECT count(*) FROM {source} WHERE {col} IS NOT NULL AND least(floor((CAST({col} AS DOUBLE) - lo) / ((hi - lo) / {bins})), {bins - 1}) = b) AS n
    FROM (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {source}), (SELECT unnest(range({bins})) AS b)"""


@query("histogram_total_scores", cleaned_sql(_histogram_sql(T, "cleaned", 13)))
def histogram_total_scores(spark, sf_dir):
    return profile.histogram(cleaned(spark, sf_dir), T, 13)


@query("histogram_months", cleaned_sql(_histogram_sql("patient_age_months", "cleaned", 30)))
def histogram_months(spark, sf_dir):
    return profile.histogram(cleaned(spark, sf_dir), "patient_age_months", 30)


@query("histogram_quantity", _histogram_sql("l_quantity", "lineitem", 30))
def histogram_quantity(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 30)


def _box_sql(col: str, source: str) -> str:
    return f"""SELECT q1, median, q3, (SELECT CAST(min({col}) AS DOUBLE) FROM {source} WHERE {col} BETWEEN lo AND hi) AS whisker_low,
    (SELECT CAST(max({col}) AS DOUBLE) FROM {source} WHERE {col} BETWEEN lo AND hi) AS whisker_high,
    (SELECT count(*) FROM {source} WHERE {col} < lo OR {col} > hi) AS n_outliers
    FROM (SELECT *, q1 - (q3 - q1) * 1.5e0 AS lo, q3 + (q3 - q1) * 1.5e0 AS hi FROM (SELECT
    quantile_cont(CAST({col} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({col} AS DOUBLE), 0.5) AS median,
    quantile_cont(CAST({col} AS DOUBLE), 0.75) AS q3 FROM {source}))"""


@query("box_total_scores", cleaned_sql(_box_sql(T, "cleaned")))
def box_total_scores(spark, sf_dir):
    return profile.box_stats(cleaned(spark, sf_dir), T)


@query("box_months", cleaned_sql(_box_sql("patient_age_months", "cleaned")))
def box_months(spark, sf_dir):
    return profile.box_stats(cleaned(spark, sf_dir), "patient_age_months")


@query("box_document_lengths", _box_sql("n_chars", "documents"))
def box_document_lengths(spark, sf_dir):
    return profile.box_stats(table(spark, sf_dir, "documents"), "n_chars")


@query(
    "outcome_mean_by_age_group",
    cleaned_sql(
        f"SELECT patient_age_under_2yr, count({study.OUTCOME}) AS n, avg({study.OUTCOME}) AS rate FROM cleaned GROUP BY 1"
    ),
)
def outcome_mean_by_age_group(spark, sf_dir):
    return profile.group_rate(cleaned(spark, sf_dir), study.AGE_GROUP, study.OUTCOME)


@query(
    "split_by_total_score",
    cleaned_sql(
        f"SELECT {count_if(f'{T} < 14')} AS n_below, {count_if(f'{T} >= 14')} AS n_from, {count_if(f'{T} IS NULL')} AS n_missing FROM cleaned"
    ),
)
def split_by_total_score(spark, sf_dir):
    return profile.split_counts(cleaned(spark, sf_dir), T, 14)
