"""Projection, casting, derived columns, filters and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, cleaned, named, nulled, query, raw, table
from catalog.oracle import (
    COLUMNS,
    NAMES,
    bands_sql,
    bins_sql,
    cleaned_sql,
    count_if,
    div,
    in_list,
    labels_sql,
    named_sql,
    nulled_sql,
    pct,
    raw_sql,
)
from wardbook.functions.predicates import any_of, not_one_of, one_of
from wardbook.functions.predicates import count_if as count_where
from wardbook.operators import filters, project
from wardbook.operators.rates import rate_table
from wardbook.plans import head_trauma as study

FLAGS_SQL = {
    name: "CASE WHEN " + " OR ".join(f"{c} IN {in_list(codes)}" for c, codes in tests) + " THEN 1 ELSE 0 END"
    for name, tests in study.PREDICTOR_FLAGS.items()
}
QUANTITY_EDGES, QUANTITY_LABELS = [0, 10, 25, 40, 50], ["tiny", "small", "medium", "large"]
BALANCE_EDGES, BALANCE_LABELS = [-1000, 0, 2500, 5000, 10000], ["debt", "low", "middle", "high"]


@query("rename_columns", raw_sql("SELECT " + ", ".join(f"{r} AS {n}" for r, n in NAMES.items()) + " FROM visits"))
def rename_columns(spark, sf_dir):
    return project.rename_from_map(raw(spark, sf_dir), study.NAME_MAPPING)


@query("null_sentinel_codes", nulled_sql("SELECT * FROM nulled"))
def null_sentinel_codes(spark, sf_dir):
    return nulled(spark, sf_dir)


@query(
    "null_sentinel_codes_but_age",
    named_sql(
        "SELECT event_id, patient_age_months, nullif(patient_number, 92) AS patient_number,"
        " nullif(seizure_timing, 92) AS seizure_timing FROM named"
    ),
)
def null_sentinel_codes_but_age(spark, sf_dir):
    """92 months is a real age: the column is left out of the replacement."""
    kept = project.null_codes(named(spark, sf_dir), [92], exclude=[KEY, "patient_age_months"])
    return kept.select(KEY, "patient_age_months", "patient_number", "seizure_timing")


@query(
    "apply_types",
    nulled_sql(
        "SELECT event_id, " + ", ".join(
            f"CAST({c} AS {'BIGINT' if c == 'patient_number' else 'INTEGER'}) AS {c}" for c in COLUMNS if c != "event_id"
        ) + " FROM nulled"
    ),
)
def apply_types(spark, sf_dir):
    return project.apply_types(nulled(spark, sf_dir), study.COLUMN_TYPES)


PLANTED_TEXT = "CASE WHEN has_vomiting_post_injury = 1 THEN 'n/a' ELSE concat(gcs_total_score, '.0') END"


@query(
    "coerce_numeric",
    named_sql(
        f"SELECT event_id, try_cast({PLANTED_TEXT} AS DOUBLE) AS total_number,"
        f" CAST(try_cast({PLANTED_TEXT} AS DOUBLE) AS INTEGER) AS total_code FROM named"
    ),
)
def coerce_numeric(spark, sf_dir):
    """Totals rendered as text, with "n/a" planted, parsed as number and as code."""
    text = named(spark, sf_dir).select(KEY, F.expr(PLANTED_TEXT).alias("total_number"))
    numbers = project.coerce_columns(text, ["total_number"])
    return numbers.withColumn("total_code", F.col("total_number").cast("int"))


@query(
    "label_mechanisms",
    nulled_sql(
        f"SELECT event_id, injury_mechanism, coalesce({labels_sql('injury_mechanism', study.MECHANISM_LABELS)}, 'Unknown') AS mechanism FROM nulled"
    ),
)
def label_mechanisms(spark, sf_dir):
    visits = nulled(spark, sf_dir).select(KEY, "injury_mechanism")
    return project.label_codes(visits, "injury_mechanism", study.MECHANISM_LABELS, "mechanism", default="Unknown")


@query(
    "label_customer_nations",
    "SELECT c_custkey, c_nationkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def label_customer_nations(spark, sf_dir):
    """Labels from a dimension table instead of a dict."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return project.label_codes(customers, "c_nationkey", nations, "nation")


@query(
    "bin_age_groups",
    nulled_sql(
        f"SELECT event_id, patient_age_years, {bins_sql('patient_age_years', study.AGE_EDGES, study.AGE_LABELS)} AS age_group FROM nulled"
    ),
)
def bin_age_groups(spark, sf_dir):
    visits = nulled(spark, sf_dir).select(KEY, "patient_age_years")
    return project.bin_right(visits, "patient_age_years", study.AGE_EDGES, study.AGE_LABELS, "age_group")


@query(
    "bin_account_balance",
    f"SELECT c_custkey, {bins_sql('c_acctbal', BALANCE_EDGES, BALANCE_LABELS)} AS balance FROM customer",
)
def bin_account_balance(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return project.bin_right(customers, "c_acctbal", BALANCE_EDGES, BALANCE_LABELS, "balance").select("c_custkey", "balance")


@query(
    "bin_quantity",
    f"SELECT {bins_sql('l_quantity', QUANTITY_EDGES, QUANTITY_LABELS)} AS size, count(*) AS n FROM lineitem GROUP BY 1",
)
def bin_quantity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    binned = project.bin_right(lines, "l_quantity", QUANTITY_EDGES, QUANTITY_LABELS, "size")
    return binned.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(
    "band_life_stages",
    nulled_sql(f"SELECT event_id, {bands_sql('patient_age_years', study.LIFE_STAGES)} AS stage FROM nulled"),
)
def band_life_stages(spark, sf_dir):
    visits = nulled(spark, sf_dir).select(KEY, "patient_age_years")
    return project.band_left(visits, "patient_age_years", study.LIFE_STAGES, "stage").select(KEY, "stage")


@query(
    "tier_mechanism_rates",
    cleaned_sql(
        f"""SELECT injury_mechanism, rate, CASE WHEN rate > 3 THEN 'high' WHEN rate > 1.5 THEN 'medium' ELSE 'low' END AS risk_tier,
        CASE WHEN rate > 2 THEN 'high' WHEN rate > 1 THEN 'medium' ELSE 'low' END AS bar_tier
        FROM (SELECT injury_mechanism, {pct(count_if('has_clinically_important_tbi = 1'), 'count(has_clinically_important_tbi)')} AS rate
              FROM cleaned WHERE injury_mechanism IS NOT NULL GROUP BY 1)"""
    ),
)
def tier_mechanism_rates(spark, sf_dir):
    rates = rate_table(cleaned(spark, sf_dir), "injury_mechanism", study.OUTCOME).select("injury_mechanism", "rate")
    tiers = project.tier(rates, "rate", study.RATE_TIERS, study.RATE_TIER_DEFAULT, "risk_tier")
    return project.tier(tiers, "rate", study.BAR_TIERS, study.BAR_TIER_DEFAULT, "bar_tier")


@query(
    "flag_population",
    nulled_sql("SELECT event_id, CASE WHEN gcs_total_score >= 14 THEN 1 ELSE 0 END AS in_primary_analysis FROM nulled"),
)
def flag_population(spark, sf_dir):
    visits = nulled(spark, sf_dir).select(KEY, study.GCS_TOTAL)
    return project.flag_at_least(visits, study.GCS_TOTAL, 14, study.PRIMARY_FLAG).select(KEY, study.PRIMARY_FLAG)


@query(
    "derive_predictor_flags",
    nulled_sql("SELECT event_id, " + ", ".join(f"{sql} AS {n}" for n, sql in FLAGS_SQL.items()) + " FROM nulled"),
)
def derive_predictor_flags(spark, sf_dir):
    return project.derive_flags(nulled(spark, sf_dir), study.PREDICTOR_FLAGS).select(KEY, *study.PREDICTOR_FLAGS)


@query(
    "recode_age_flag",
    nulled_sql("SELECT event_id, CASE WHEN patient_age_under_2yr = 1 THEN 1 ELSE 0 END AS is_under_2 FROM nulled"),
)
def recode_age_flag(spark, sf_dir):
    return project.recode_binary(nulled(spark, sf_dir), study.AGE_GROUP, 1, "is_under_2").select(KEY, "is_under_2")


@query(
    "scale_months",
    cleaned_sql(
        f"SELECT event_id, {div('patient_age_months - lo', 'hi - lo')} AS scaled FROM cleaned,"
        " (SELECT min(patient_age_months) AS lo, max(patient_age_months) AS hi FROM cleaned)"
    ),
)
def scale_months(spark, sf_dir):
    visits = cleaned(spark, sf_dir).select(KEY, "patient_age_months")
    return project.min_max_scale(visits, "patient_age_months", "scaled").select(KEY, "scaled")


@query(
    "scale_price",
    "SELECT l_orderkey, l_partkey, l_linenumber, (l_extendedprice - lo) / nullif(hi - lo, 0) AS scaled FROM lineitem,"
    " (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)",
)
def scale_price(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return project.min_max_scale(lines, "l_extendedprice", "scaled").drop("l_extendedprice")


@query(
    "restrict_population",
    cleaned_sql("SELECT event_id, gcs_total_score FROM cleaned WHERE in_primary_analysis = 1"),
)
def restrict_population(spark, sf_dir):
    return filters.restrict(cleaned(spark, sf_dir), study.PRIMARY_FLAG).select(KEY, study.GCS_TOTAL)


@query(
    "drop_missing_outcome",
    cleaned_sql(
        "SELECT event_id, has_clinically_important_tbi FROM cleaned WHERE has_clinically_important_tbi IS NOT NULL"
    ),
)
def drop_missing_outcome(spark, sf_dir):
    return filters.drop_missing(cleaned(spark, sf_dir), [study.OUTCOME]).select(KEY, study.OUTCOME)


@query(
    "code_membership",
    nulled_sql(
        f"""SELECT {count_if('gcs_total_score IN (14, 15)')} AS n_inside,
        {count_if('gcs_eye_score NOT IN (1, 2, 3, 4) OR gcs_verbal_score NOT IN (1, 2, 3, 4, 5)')} AS n_outside,
        {count_if('gcs_eye_score IS NULL')} AS n_unknown FROM nulled"""
    ),
)
def code_membership(spark, sf_dir):
    """Code sets, positive and negated; a missing score is in neither."""
    outside = any_of([not_one_of("gcs_eye_score", [1, 2, 3, 4]), not_one_of("gcs_verbal_score", [1, 2, 3, 4, 5])])
    return nulled(spark, sf_dir).selectExpr(
        f"{count_where(one_of(study.GCS_TOTAL, [14, 15]))} AS n_inside",
        f"{count_where(outside)} AS n_outside",
        "count_if(gcs_eye_score IS NULL) AS n_unknown",
    )


@query("first_visits", named_sql("SELECT * FROM named ORDER BY event_id LIMIT 5"))
def first_visits(spark, sf_dir):
    return filters.peek(named(spark, sf_dir), 5, KEY)


@query("last_visits", named_sql("SELECT * FROM named ORDER BY event_id DESC LIMIT 5"))
def last_visits(spark, sf_dir):
    return filters.peek(named(spark, sf_dir), 5, KEY, last=True)


@query("table_shape", named_sql(f"SELECT count(*) AS n_rows, {len(COLUMNS)} AS n_columns FROM named"))
def table_shape(spark, sf_dir):
    return filters.shape(named(spark, sf_dir))


@query(
    "top_mechanisms",
    cleaned_sql(
        "SELECT injury_mechanism, count(*) AS n FROM cleaned WHERE injury_mechanism IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6"
    ),
)
def top_mechanisms(spark, sf_dir):
    return filters.top_k_values(cleaned(spark, sf_dir), "injury_mechanism", 6)


@query("top_brands", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_brands(spark, sf_dir):
    return filters.top_k_values(table(spark, sf_dir, "part"), "p_brand", 10)


@query(
    "visits_with_top_mechanism",
    cleaned_sql(
        """SELECT event_id, injury_mechanism FROM cleaned WHERE injury_mechanism IN (SELECT injury_mechanism FROM
        (SELECT injury_mechanism, count(*) AS n FROM cleaned WHERE injury_mechanism IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5))"""
    ),
)
def visits_with_top_mechanism(spark, sf_dir):
    return filters.filter_top_k(cleaned(spark, sf_dir), "injury_mechanism", 5).select(KEY, "injury_mechanism")


@query(
    "parts_of_top_brands",
    """SELECT p_brand, count(*) AS n_parts FROM part WHERE p_brand IN (SELECT p_brand FROM
    (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3)) GROUP BY 1""",
)
def parts_of_top_brands(spark, sf_dir):
    parts = filters.filter_top_k(table(spark, sf_dir, "part"), "p_brand", 3)
    return parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))
