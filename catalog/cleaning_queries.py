"""Cleaning, deterministic imputation and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, clean_lazily, nulled, query, raw, table
from catalog.oracle import (
    CATEGORY_SQL,
    COLUMNS,
    CTES,
    MONTHS_SQL,
    PROMOTE_SQL,
    SNAP_SQL,
    TOTAL_SQL,
    E,
    M,
    T,
    V,
    cleaned_sql,
    count_if,
    ids_filled,
    nulled_sql,
    report_sql,
    sql_rules,
    union_rows,
    with_ctes,
)
from wardbook.operators import cleaning
from wardbook.operators.identifiers import fill_id_gaps
from wardbook.operators.repair import (
    repair,
    repair_category,
    repair_codes,
    repair_dependents,
    repair_implies,
    repair_ratio,
)
from wardbook.operators.validate import validate
from wardbook.plans import head_trauma as study
from wardbook.plans.cleaning import CleanConfig, clean, present_dependents, standard_repair, standard_rules
from wardbook.session import scratch_path

PARTS = [E, V, M, T]
PARTS_SQL = ", ".join(PARTS)


@query(
    "snap_codes",
    nulled_sql(f"SELECT event_id, {SNAP_SQL[E]} AS {E}, {SNAP_SQL[V]} AS {V}, {SNAP_SQL[T]} AS {T} FROM nulled"),
)
def snap_codes(spark, sf_dir):
    return cleaning.snap_codes(nulled(spark, sf_dir), study.GCS_SNAPS, T).select(KEY, E, V, T)


@query("impute_from_total", with_ctes("imputed", f"SELECT event_id, {PARTS_SQL} FROM imputed"))
def impute_from_total(spark, sf_dir):
    return cleaning.impute_from_total(nulled(spark, sf_dir), study.GCS_PARTS, T).select(KEY, *PARTS)


@query("rederive_total", nulled_sql(f"SELECT event_id, {TOTAL_SQL} AS {T} FROM nulled"))
def rederive_total(spark, sf_dir):
    return cleaning.rederive_total(nulled(spark, sf_dir), study.GCS_PARTS, T).select(KEY, T)


@query("rederive_category", nulled_sql(f"SELECT event_id, {CATEGORY_SQL} AS gcs_category FROM nulled"))
def rederive_category(spark, sf_dir):
    fixed = cleaning.rederive_category(nulled(spark, sf_dir), T, study.GCS_CATEGORIES, "gcs_category")
    return fixed.select(KEY, "gcs_category")


@query("promote_flag", nulled_sql(f"SELECT event_id, {PROMOTE_SQL} AS ct_shows_tbi FROM nulled"))
def promote_flag(spark, sf_dir):
    visits = nulled(spark, sf_dir)
    findings = [c for c in study.FINDING_COLUMNS if c in visits.columns]
    return cleaning.promote_flag(visits, "ct_shows_tbi", findings, "skull_fracture_depressed").select(KEY, "ct_shows_tbi")


@query(
    "fill_id_gaps",
    nulled_sql(
        "SELECT event_id, coalesce(patient_number, new_id) AS patient_number FROM nulled LEFT JOIN filled ON event_id = key_value",
        filled=ids_filled("nulled", "patient_number", "event_id"),
    ),
)
def fill_gaps_in_patient_numbers(spark, sf_dir):
    return fill_id_gaps(nulled(spark, sf_dir).select(KEY, "patient_number"), "patient_number", KEY)


PLANTED_KEY = "CASE WHEN o_orderkey % 997 = 500 THEN NULL ELSE o_orderkey END"


@query(
    "fill_order_id_gaps",
    f"""WITH planted AS (SELECT o_orderkey AS row_key, {PLANTED_KEY} AS order_id FROM orders),
    filled AS ({ids_filled('planted', 'order_id', 'row_key')})
    SELECT row_key, coalesce(order_id, new_id) AS order_id FROM planted LEFT JOIN filled ON row_key = key_value""",
)
def fill_order_id_gaps(spark, sf_dir):
    """The orders table with ids planted as missing."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_key"), F.expr(PLANTED_KEY).alias("order_id")
    )
    return fill_id_gaps(orders, "order_id", "row_key")


SEVENTH_KEY = "CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_orderkey END"


@query(
    "fill_every_seventh_id",
    f"""WITH planted AS (SELECT -o_orderkey AS row_key, {SEVENTH_KEY} AS order_id FROM orders),
    filled AS ({ids_filled('planted', 'order_id', 'row_key')})
    SELECT row_key, coalesce(order_id, new_id) AS order_id FROM planted LEFT JOIN filled ON row_key = key_value""",
)
def fill_every_seventh_id(spark, sf_dir):
    """A seventh of the orders without id, in the reverse order of their keys, which are negative."""
    orders = table(spark, sf_dir, "orders").selectExpr("-o_orderkey AS row_key", f"{SEVENTH_KEY} AS order_id")
    return fill_id_gaps(orders, "order_id", "row_key")


@query("fill_newborn_months", nulled_sql(f"SELECT event_id, {MONTHS_SQL} AS patient_age_months FROM nulled"))
def fill_newborn_months(spark, sf_dir):
    filled = cleaning.fill_when(nulled(spark, sf_dir), "patient_age_months", "patient_age_years = 0", 0)
    return filled.select(KEY, "patient_age_months")


def _chain(threshold: int = 14, impute: bool = True, promote: bool = True) -> str:
    """The cleaning chain with its switches, identifiers filled, as SQL."""
    steps = dict(CTES)
    if not impute:
        steps["imputed"] = "SELECT * FROM nulled"
    if not promote:
        steps["promoted"] = "SELECT * FROM categorised"
    steps["cleaned"] = steps["cleaned"].replace(f"{T} >= 14", f"{T} >= {threshold}")
    steps["filled"] = ids_filled("nulled", "patient_number", "event_id")
    chain = ", ".join(f"{name} AS ({text})" for name, text in steps.items())
    columns = ", ".join(
        "coalesce(patient_number, new_id) AS patient_number" if c == "patient_number" else c
        for c in [*COLUMNS, "in_primary_analysis"]
    )
    return f"WITH {chain} SELECT {columns} FROM cleaned LEFT JOIN filled ON event_id = key_value"


@query("clean_visits", _chain())
def clean_visits(spark, sf_dir):
    return clean_lazily(spark, sf_dir, order_by=KEY)


@query("clean_visits_perturbed", _chain(threshold=13))
def clean_visits_perturbed(spark, sf_dir):
    return clean_lazily(spark, sf_dir, order_by=KEY, gcs_threshold=13)


@query("clean_visits_unimputed", _chain(impute=False, promote=False))
def clean_visits_unimputed(spark, sf_dir):
    return clean_lazily(spark, sf_dir, order_by=KEY, impute_gcs=False, fix_ct_tbi=False)


@query("clean_visits_report", cleaned_sql(report_sql(sql_rules(), "cleaned")))
def clean_visits_report(spark, sf_dir):
    """The report that cleaning returns when asked to validate, here of the saved table."""
    saved = scratch_path(spark, "cleaned")
    return clean(raw(spark, sf_dir), CleanConfig(keep_codes=(KEY,), order_by=KEY), save_to=saved).report


@query("clean_visits_default", _chain())
def clean_visits_default(spark, sf_dir):
    """All twelve steps, identifiers and validation included, saved and read back."""
    return clean(raw(spark, sf_dir), CleanConfig(keep_codes=(KEY,), order_by=KEY), save_to=scratch_path(spark, "cleaned")).data


# Repair. The oracle counts every fix on the state its stage starts from.

CHILDREN = [
    (parent, child)
    for parent, children in study.DEPENDENTS.items()
    for child in children
    if parent in COLUMNS and child in COLUMNS
]
MONTHS_RULE = "floor(patient_age_months / 12) <> patient_age_years"
AGE_RULE = "patient_age_under_2yr <> CASE WHEN patient_age_years < 2 THEN 1 WHEN patient_age_years >= 2 THEN 2 END"
PALPABLE_RULE = "skull_fracture_depressed = 1 AND has_palpable_skull_fracture IS DISTINCT FROM 1"
COMPOUND_RULE = (
    "hospitalized_2plus_nights_with_positive_ct = 1 AND (hospitalized_2plus_nights_head_injury IS DISTINCT FROM 1"
    " OR ct_shows_tbi IS DISTINCT FROM 1)"
)
CT_RULE = "head_ct_performed_in_ed = 1 AND head_ct_performed IS DISTINCT FROM 1"


def _orphan(parent: str, child: str) -> str:
    return f"coalesce({parent}, 0) = 0 AND {child} <> 0"


def _with(source: str, changes: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{changes[c]} AS {c}' if c in changes else c for c in COLUMNS)} FROM {source}"


REPAIR_STAGES = {
    "stage1": _with("nulled", SNAP_SQL),
    "stage2": _with("stage1", {c: f"CASE WHEN {_orphan(p, c)} THEN NULL ELSE {c} END" for p, c in CHILDREN}),
    "stage3": _with("stage2", {"patient_age_months": f"CASE WHEN {MONTHS_RULE} THEN NULL ELSE patient_age_months END"}),
    "stage4": _with(
        "stage3",
        {
            "patient_age_under_2yr": f"CASE WHEN {AGE_RULE} THEN (CASE WHEN patient_age_years < 2 THEN 1 ELSE 2 END)"
            " ELSE patient_age_under_2yr END"
        },
    ),
    "stage5": _with(
        "stage4",
        {
            "has_palpable_skull_fracture": f"CASE WHEN {PALPABLE_RULE} THEN 1 ELSE has_palpable_skull_fracture END",
            "hospitalized_2plus_nights_with_positive_ct": f"CASE WHEN {COMPOUND_RULE} THEN NULL"
            " ELSE hospitalized_2plus_nights_with_positive_ct END",
            "head_ct_performed": f"CASE WHEN {CT_RULE} THEN 1 ELSE head_ct_performed END",
        },
    ),
}


def _repair_sql(final: str) -> str:
    return nulled_sql(final, **REPAIR_STAGES)


def _fix_row(step: str, fix: str, column: str, n: str) -> dict[str, str]:
    return {"step": f"'{step}'", "fix": f"'{fix}'", '"column"': f"'{column}'", "n_fixed": n}


SNAP_ROWS = [_fix_row("codes", f"{c} {bad} -> {good}", c, count_if(f"{c} = {bad}")) for c, bad, good, _ in study.GCS_SNAPS]
DEPENDENT_ROWS = [_fix_row("dependents", f"{c} without {p}", c, count_if(_orphan(p, c))) for p, c in CHILDREN]
RATIO_ROWS = [
    _fix_row("ratio", "patient_age_months // 12 = patient_age_years", "patient_age_months", count_if(MONTHS_RULE))
]
CATEGORY_ROWS = [
    _fix_row("category", "patient_age_under_2yr by patient_age_years", "patient_age_under_2yr", count_if(AGE_RULE))
]
IMPLIES_ROWS = [
    _fix_row(
        "implies", "skull_fracture_depressed needs has_palpable_skull_fracture", "has_palpable_skull_fracture",
        count_if(PALPABLE_RULE),
    ),
    _fix_row(
        "implies",
        "hospitalized_2plus_nights_with_positive_ct needs hospitalized_2plus_nights_head_injury and ct_shows_tbi",
        "hospitalized_2plus_nights_with_positive_ct", count_if(COMPOUND_RULE),
    ),
    _fix_row("implies", "head_ct_performed_in_ed needs head_ct_performed", "head_ct_performed", count_if(CT_RULE)),
]


def _counts_sql(rows: list[dict[str, str]]) -> str:
    return nulled_sql(
        "SELECT * FROM fixes UNION ALL SELECT 'total', 'all fixes', NULL, CAST(sum(n_fixed) AS BIGINT) FROM fixes",
        fixes=union_rows(rows, "nulled"),
    )


@query("repair_codes_counts", _counts_sql(SNAP_ROWS))
def repair_codes_counts(spark, sf_dir):
    return repair(nulled(spark, sf_dir), [repair_codes(study.GCS_SNAPS, T)])[1]


@query("repair_dependents_counts", _counts_sql(DEPENDENT_ROWS))
def repair_dependents_counts(spark, sf_dir):
    visits = nulled(spark, sf_dir)
    return repair(visits, [repair_dependents(present_dependents(visits))])[1]


@query("repair_ratio_counts", _counts_sql(RATIO_ROWS))
def repair_ratio_counts(spark, sf_dir):
    return repair(nulled(spark, sf_dir), [repair_ratio("patient_age_months", "patient_age_years", 12)])[1]


@query("repair_category_counts", _counts_sql(CATEGORY_ROWS))
def repair_category_counts(spark, sf_dir):
    return repair(nulled(spark, sf_dir), [repair_category("patient_age_years", "patient_age_under_2yr", 2)])[1]


@query("repair_implies_counts", _counts_sql(IMPLIES_ROWS))
def repair_implies_counts(spark, sf_dir):
    """Without the stages before it, also rows whose parent is 0 or null are set."""
    stage = [
        *repair_implies("skull_fracture_depressed", "has_palpable_skull_fracture", "set"),
        *repair_implies(
            "hospitalized_2plus_nights_with_positive_ct",
            ["hospitalized_2plus_nights_head_injury", "ct_shows_tbi"],
            "null",
        ),
        *repair_implies("head_ct_performed_in_ed", "head_ct_performed", "set"),
    ]
    return repair(nulled(spark, sf_dir), [stage])[1]


@query("repair_visits", _repair_sql("SELECT * FROM stage5"))
def repair_visits(spark, sf_dir):
    visits = nulled(spark, sf_dir)
    return repair(visits, standard_repair(visits))[0]


@query(
    "repair_visits_counts",
    _repair_sql(
        "SELECT * FROM fixes UNION ALL SELECT 'total', 'all fixes', NULL, CAST(sum(n_fixed) AS BIGINT) FROM fixes"
    ).replace(
        " SELECT * FROM fixes",
        ", fixes AS ("
        + " UNION ALL ".join(
            union_rows(rows, source)
            for rows, source in (
                (SNAP_ROWS, "nulled"),
                (DEPENDENT_ROWS, "stage1"),
                (RATIO_ROWS, "stage2"),
                (CATEGORY_ROWS, "stage3"),
                (IMPLIES_ROWS, "stage4"),
            )
        )
        + ") SELECT * FROM fixes",
        1,
    ),
)
def repair_visits_counts(spark, sf_dir):
    visits = nulled(spark, sf_dir)
    return repair(visits, standard_repair(visits))[1]


@query("revalidate_repaired", _repair_sql(report_sql(sql_rules(), "stage5")))
def revalidate_repaired(spark, sf_dir):
    """Validation after repair: what is left needs a human."""
    visits = nulled(spark, sf_dir)
    fixed, _ = repair(visits, standard_repair(visits))
    return validate(fixed, standard_rules(fixed))
