"""Validation: counts and row-level violations."""

from __future__ import annotations

from catalog.base import KEY, cleaned, named, nulled, query, table
from catalog.oracle import (
    CODED,
    FINDINGS,
    E,
    T,
    V,
    cleaned_sql,
    count_if,
    named_sql,
    nulled_sql,
    pct,
    report_sql,
    sql_rules,
    union_rows,
    violations_sql,
)
from wardbook.functions.predicates import absent, all_of, any_equals, equals, known, negate
from wardbook.operators import duplicates, rules, validate
from wardbook.plans import head_trauma as study
from wardbook.plans.cleaning import present_dependents, standard_rules

RULES = sql_rules()


def _of(check: str) -> list:
    return [r for r in RULES if r[0] == check]


@query("check_codes", nulled_sql(report_sql(_of("codes"), "nulled")))
def check_codes(spark, sf_dir):
    visits = nulled(spark, sf_dir)
    codes = {c: allowed for c, allowed in study.VALID_CODES.items() if c in visits.columns}
    return validate.validate(visits, rules.valid_codes(codes))


@query(
    "bad_code_values",
    nulled_sql(
        'SELECT "check", rule, "column", "value", count(*) AS n FROM bad GROUP BY ALL',
        bad=violations_sql(_of("codes"), "nulled"),
    ),
)
def bad_code_values(spark, sf_dir):
    """Which values lie outside the code lists, and how often each of them occurs."""
    visits = nulled(spark, sf_dir)
    codes = {c: allowed for c, allowed in study.VALID_CODES.items() if c in visits.columns}
    return validate.bad_values(visits, rules.valid_codes(codes))


@query("check_dependents", nulled_sql(report_sql(_of("dependents"), "nulled")))
def check_dependents(spark, sf_dir):
    visits = nulled(spark, sf_dir)
    return validate.validate(visits, rules.dependents(present_dependents(visits)))


EXPLORED = [
    (p, [c for c in children if c in CODED])
    for p, children in study.EXPLORED_DEPENDENTS.items()
    if p in CODED and any(c in CODED for c in children)
]


@query(
    "check_dependents_explored",
    nulled_sql(
        report_sql(
            [
                (
                    "dependents",
                    f"{p} absent",
                    p,
                    f"coalesce({p}, 0) = 0 AND (" + " OR ".join(f"{c} IS NOT NULL" for c in kids) + ")",
                )
                for p, kids in EXPLORED
            ],
            "nulled",
        )
    ),
)
def check_dependents_explored(spark, sf_dir):
    """The longer parent list, with any recorded detail counting, a 0 too."""
    visits = nulled(spark, sf_dir)
    parents = present_dependents(visits, study.EXPLORED_DEPENDENTS)
    return validate.validate(visits, rules.dependents(parents, zero_is_value=True))


@query(
    "check_age_ratio",
    nulled_sql(
        report_sql(
            [
                *_of("ratio"),
                (
                    "ratio",
                    "patient_age_months within patient_age_years",
                    "patient_age_months",
                    "patient_age_months < patient_age_years * 12 OR patient_age_months >= patient_age_years * 12 + 12",
                ),
            ],
            "nulled",
        )
    ),
)
def check_age_ratio(spark, sf_dir):
    """Months against years, from either side."""
    pair = [
        rules.consistent_ratio("patient_age_months", "patient_age_years", 12),
        rules.within_unit("patient_age_months", "patient_age_years", 12),
    ]
    return validate.validate(nulled(spark, sf_dir), pair)


BOTH = "patient_age_months IS NOT NULL AND patient_age_years IS NOT NULL"
AGREE = "floor(patient_age_months / 12) = patient_age_years"


@query(
    "age_ratio_agreement",
    nulled_sql(
        f"""SELECT {count_if(BOTH)} AS n_both, {count_if(AGREE)} AS n_consistent, {count_if(f'NOT ({AGREE})')} AS n_inconsistent,
        {count_if(f'NOT ({BOTH})')} AS n_incomplete, {pct(count_if(AGREE), count_if(BOTH))} AS pct_consistent FROM nulled"""
    ),
)
def age_ratio_agreement(spark, sf_dir):
    return validate.ratio_agreement(nulled(spark, sf_dir), "patient_age_months", "patient_age_years", 12)


@query(
    "check_categories",
    nulled_sql(
        report_sql(
            [
                *_of("category"),
                (
                    "category",
                    "gcs_category by gcs_total_score",
                    "gcs_category",
                    "gcs_category <> CASE WHEN gcs_total_score <= 13 THEN 1 WHEN gcs_total_score >= 14 THEN 2 END",
                ),
            ],
            "nulled",
        )
    ),
)
def check_categories(spark, sf_dir):
    pair = [
        rules.category_by_cut("patient_age_years", "patient_age_under_2yr", 2),
        rules.category_by_ranges(T, "gcs_category", study.GCS_CATEGORIES),
    ]
    return validate.validate(nulled(spark, sf_dir), pair)


@query("check_implications", nulled_sql(report_sql(_of("implies"), "nulled")))
def check_implications(spark, sf_dir):
    needed = [
        rules.implies("skull_fracture_depressed", "has_palpable_skull_fracture"),
        rules.implies(
            "hospitalized_2plus_nights_with_positive_ct",
            ["hospitalized_2plus_nights_head_injury", "ct_shows_tbi"],
        ),
        rules.implies("head_ct_performed_in_ed", "head_ct_performed"),
    ]
    return validate.validate(nulled(spark, sf_dir), needed)


CROSS = "head_ct_performed_in_ed = 0 AND ct_shows_tbi = 1 AND head_ct_performed IS DISTINCT FROM 1"


@query(
    "check_cross_columns",
    nulled_sql(
        report_sql(
            [
                ("custom", "positive CT without a CT", "ct_shows_tbi", CROSS),
                ("custom", "CT outside the ED", "ct_shows_tbi",
                 "coalesce(head_ct_performed_in_ed, 0) = 0 AND ct_shows_tbi IS NOT NULL"),
            ],
            "nulled",
        )
    ),
)
def check_cross_columns(spark, sf_dir):
    """Rules given as predicates."""
    own = [
        rules.rule(
            "positive CT without a CT",
            all_of(
                [equals("head_ct_performed_in_ed", 0), equals("ct_shows_tbi", 1), negate(equals("head_ct_performed", 1))]
            ),
            "ct_shows_tbi",
        ),
        rules.rule(
            "CT outside the ED", all_of([absent("head_ct_performed_in_ed"), known("ct_shows_tbi")]), "ct_shows_tbi"
        ),
    ]
    return validate.validate(nulled(spark, sf_dir), own)


UNCOVERED = f"coalesce(ct_shows_tbi, 0) = 0 AND ({FINDINGS[0]} = 1 OR {FINDINGS[1]} = 1)"


@query(
    "check_flag_covers_findings",
    nulled_sql(report_sql([("findings", "ct_shows_tbi covers findings", "ct_shows_tbi", UNCOVERED)], "nulled")),
)
def check_flag_covers_findings(spark, sf_dir):
    return validate.validate(nulled(spark, sf_dir), [rules.flag_covers("ct_shows_tbi", FINDINGS)])


@query(
    "findings_among_violations",
    nulled_sql(
        "SELECT * FROM found WHERE n > 0",
        found=union_rows(
            [{"finding": f"'{c}'", "n": count_if(f"{c} = 1 AND {UNCOVERED}")} for c in FINDINGS], "nulled"
        ),
    ),
)
def findings_among_violations(spark, sf_dir):
    uncovered = all_of([absent("ct_shows_tbi"), any_equals(FINDINGS, 1)])
    return validate.findings_among(nulled(spark, sf_dir), uncovered, FINDINGS)


COMBO = ["ct_shows_tbi", "ct_finding_skull_fracture", "skull_fracture_depressed"]


@query(
    "violation_combinations",
    nulled_sql(
        f"""SELECT {', '.join(COMBO)}, count(*) AS n FROM nulled WHERE {UNCOVERED}
        AND {' AND '.join(f'{c} IS NOT NULL' for c in COMBO)} GROUP BY {', '.join(COMBO)}"""
    ),
)
def violation_combinations(spark, sf_dir):
    uncovered = all_of([absent("ct_shows_tbi"), any_equals(FINDINGS, 1)])
    return validate.combo_counts(nulled(spark, sf_dir).where(uncovered), COMBO)


@query("validate_visits", nulled_sql(report_sql(RULES, "nulled")))
def validate_visits(spark, sf_dir):
    """All rules in one pass over the uncorrected visits."""
    visits = nulled(spark, sf_dir)
    return validate.validate(visits, standard_rules(visits))


@query(
    "validate_visits_with_values",
    nulled_sql(
        f"""SELECT 'rule' AS level, "check", rule, "column", CAST(NULL AS BIGINT) AS "value", n_violations AS n FROM ({report_sql(RULES, 'nulled')})
        UNION ALL SELECT 'value', "check", rule, "column", "value", count(*) FROM bad GROUP BY ALL""",
        bad=violations_sql(RULES, "nulled"),
    ),
)
def validate_visits_with_values(spark, sf_dir):
    """The report of all rules and, below it, the distinct bad values, from one pass."""
    visits = nulled(spark, sf_dir)
    report, values = validate.validate_with_values(visits, standard_rules(visits))
    columns = ["check", "rule", "`column`"]
    return report.selectExpr("'rule' AS level", *columns, "CAST(NULL AS BIGINT) AS value", "n_violations AS n").unionByName(
        values.selectExpr("'value' AS level", *columns, "value", "n")
    )


@query("violating_cells", nulled_sql(violations_sql(RULES, "nulled")))
def violating_cells(spark, sf_dir):
    """One row per violated rule and visit, for quarantine."""
    visits = nulled(spark, sf_dir)
    return validate.violations(visits, standard_rules(visits), KEY)


@query(
    "count_sentinel_cells",
    named_sql(
        union_rows(
            [{'"column"': f"'{c}'", "n": count_if(f"{c} = 92")} for c in CODED]
            + [{'"column"': "'all columns'", "n": " + ".join(count_if(f"{c} = 92") for c in CODED)}],
            "named",
        )
    ),
)
def count_sentinel_cells(spark, sf_dir):
    return validate.count_code(named(spark, sf_dir), 92, CODED)


ZERO_COLUMNS = [c for c in study.ZERO_IS_INVALID if c in CODED]


@query(
    "check_zeros",
    nulled_sql(report_sql([("zeros", f"{c} not 0", c, f"{c} = 0") for c in ZERO_COLUMNS], "nulled")),
)
def check_zeros(spark, sf_dir):
    return validate.validate(nulled(spark, sf_dir), rules.not_zero(ZERO_COLUMNS))


ZERO_MONTHS = {"patient_age_years": 0, "patient_age_under_2yr": 1}


@query(
    "explain_zero_months",
    cleaned_sql(
        union_rows(
            [
                {"measure": "'zero'", "n": "count(*)"},
                {"measure": "'patient_age_years = 0'", "n": count_if("patient_age_years = 0")},
                {"measure": "'patient_age_under_2yr = 1'", "n": count_if("patient_age_under_2yr = 1")},
                {
                    "measure": "'unexplained'",
                    "n": count_if("patient_age_years IS DISTINCT FROM 0 OR patient_age_under_2yr IS DISTINCT FROM 1"),
                },
            ],
            "(SELECT * FROM cleaned WHERE patient_age_months = 0)",
        )
    ),
)
def explain_zero_months(spark, sf_dir):
    return validate.explain_zeros(cleaned(spark, sf_dir), "patient_age_months", ZERO_MONTHS)


@query(
    "missing_scores_pattern",
    nulled_sql(
        f"SELECT {T}, count(*) AS n FROM nulled WHERE {E} IS NULL AND {V} IS NULL AND {T} IS NOT NULL GROUP BY 1"
    ),
)
def missing_scores_pattern(spark, sf_dir):
    """Totals of visits with neither of two scores; no visit lacks all three."""
    return validate.missing_pattern(nulled(spark, sf_dir), [E, V], T)


@query("check_upper_bound", cleaned_sql(report_sql([("bound", "patient_age_months <= 215", "patient_age_months", "patient_age_months > 215")], "cleaned")))
def check_upper_bound(spark, sf_dir):
    return validate.validate(cleaned(spark, sf_dir), [rules.at_most("patient_age_months", study.MAX_AGE_MONTHS)])


# Duplicates. ``copies`` is the whole table with some visits entered twice.

COPIES = {"copies": "SELECT * FROM cleaned UNION ALL SELECT * FROM cleaned WHERE has_clinically_important_tbi = 1"}


def _copies(spark, sf_dir):
    visits = cleaned(spark, sf_dir)
    return visits.unionByName(visits.where(equals(study.OUTCOME, 1)))


@query(
    "duplicate_visits",
    cleaned_sql(
        """SELECT (SELECT count(*) FROM copies) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS n_distinct,
        (SELECT count(*) FROM copies) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS n_duplicates,
        (SELECT count(*) FROM copies) = 43399 AS as_expected""",
        **COPIES,
    ),
)
def duplicate_visits(spark, sf_dir):
    return duplicates.duplicate_summary(_copies(spark, sf_dir), expected_rows=43399)


@query(
    "duplicate_visit_rows",
    cleaned_sql(
        "SELECT event_id, patient_number, patient_age_years, patient_gender, injury_mechanism FROM copies"
        " WHERE event_id IN (SELECT event_id FROM copies GROUP BY 1 HAVING count(*) > 1)",
        **COPIES,
    ),
)
def duplicate_visit_rows(spark, sf_dir):
    """Every copy of visits that are equal in all columns."""
    rows = duplicates.duplicate_rows(_copies(spark, sf_dir))
    return rows.select(KEY, "patient_number", "patient_age_years", "patient_gender", "injury_mechanism")


@query(
    "duplicate_texts",
    """SELECT count(*) AS n_rows, count(DISTINCT "text") AS n_distinct, count(*) - count(DISTINCT "text") AS n_duplicates FROM documents""",
)
def duplicate_texts(spark, sf_dir):
    return duplicates.duplicate_summary(table(spark, sf_dir, "documents"), ["text"])


@query(
    "documents_with_equal_text",
    'SELECT doc_id FROM documents WHERE "text" IN (SELECT "text" FROM documents GROUP BY 1 HAVING count(*) > 1)',
)
def documents_with_equal_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return duplicates.duplicate_rows(documents, ["text"]).select("doc_id")


@query(
    "duplicate_line_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN
    (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def duplicate_line_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return duplicates.duplicate_rows(lines, ["l_orderkey", "l_linenumber"])


@query("distinct_orders", "SELECT count(DISTINCT l_orderkey) AS n_distinct FROM lineitem")
def distinct_orders(spark, sf_dir):
    return duplicates.distinct_count(table(spark, sf_dir, "lineitem"), "l_orderkey")
