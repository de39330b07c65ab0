"""Rates, shares, risk ratios and the named findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import cleaned, query, table
from catalog.oracle import (
    OUTCOME,
    T,
    bands_sql,
    bins_sql,
    cleaned_sql,
    count_if,
    in_list,
    labels_sql,
    pct,
    union_rows,
    values_cte,
)
from wardbook.functions.predicates import equals, one_of
from wardbook.operators import rates, risk
from wardbook.operators.project import band_left, bin_right, flag_at_least
from wardbook.plans import findings
from wardbook.plans import head_trauma as study
from wardbook.session import settle

CASES = count_if(f"{OUTCOME} = 1")
KNOWN = f"count({OUTCOME})"
Z2 = f"{1.96 * 1.96!r}e0"


def wilson_sql(cases: str, n: str) -> str:
    """The two bounds in percent from counts in columns."""
    share, size = f"(CAST({cases} AS DOUBLE) / {n})", f"CAST({n} AS DOUBLE)"
    shrink = f"(1 + {Z2} / {size})"
    centre = f"(({share} + {Z2} / {size} / 2) / {shrink})"
    margin = f"(1.96e0 * sqrt({share} * (1 - {share}) / {size} + {Z2} / {size} / (4 * {size})) / {shrink})"
    return (
        f"greatest(0.0e0, ({centre} - {margin}) * 100) AS ci_lower, least(100.0e0, ({centre} + {margin}) * 100) AS ci_upper"
    )


def rates_sql(factor: str, source: str, denom: str, where: str = "true", outcome: str = OUTCOME) -> str:
    cases, known = count_if(f"{outcome} = 1"), f"count({outcome})"
    rate = f"coalesce({pct(cases, known)}, 0)" if denom == "known" else pct(cases, "count(*)")
    return (
        f"SELECT {factor}, count(*) AS n, {known} AS n_known, {cases} AS cases, {rate} AS rate"
        f" FROM {source} WHERE {factor} IS NOT NULL AND {where} GROUP BY {factor}"
    )


@query("rate_by_mechanism", cleaned_sql(rates_sql("injury_mechanism", "cleaned", "known")))
def rate_by_mechanism(spark, sf_dir):
    return rates.rate_table(cleaned(spark, sf_dir), "injury_mechanism", OUTCOME)


@query("rate_by_mechanism_all_rows", cleaned_sql(rates_sql("injury_mechanism", "cleaned", "all")))
def rate_by_mechanism_all_rows(spark, sf_dir):
    return rates.rate_table(cleaned(spark, sf_dir), "injury_mechanism", OUTCOME, denom="all")


@query(
    "rate_interval_by_mechanism",
    cleaned_sql(f"SELECT *, {wilson_sql('cases', 'n')} FROM ({rates_sql('injury_mechanism', 'cleaned', 'all')})"),
)
def rate_interval_by_mechanism(spark, sf_dir):
    return rates.rate_table_ci(cleaned(spark, sf_dir), "injury_mechanism", OUTCOME)


RETURNED = "(SELECT l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem)"


@query(
    "return_rate_by_line",
    f"SELECT *, {wilson_sql('cases', 'n')} FROM ({rates_sql('l_linenumber', RETURNED, 'all', outcome='returned')})",
)
def return_rate_by_line(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("returned")
    )
    return rates.rate_table_ci(lines, "l_linenumber", "returned")


@query(
    "overall_rate_in_population",
    cleaned_sql(
        f"SELECT count(*) AS n, {KNOWN} AS n_known, {CASES} AS cases, coalesce({pct(CASES, KNOWN)}, 0) AS rate FROM cleaned WHERE in_primary_analysis = 1"
    ),
)
def overall_rate_in_population(spark, sf_dir):
    return rates.overall_rate(cleaned(spark, sf_dir), OUTCOME, where=equals(study.PRIMARY_FLAG, 1))


def top_sql(source: str, code: str, k: int) -> str:
    return (
        f"SELECT {code}, row_number() OVER (ORDER BY c DESC, {code}) AS code_rank FROM"
        f" (SELECT {code}, count(*) AS c FROM {source} WHERE {code} IS NOT NULL GROUP BY {code} ORDER BY c DESC, {code} LIMIT {k})"
    )


def shares_sql(group: str, groups, code: str, k: int, source: str) -> str:
    kind = "VARCHAR" if isinstance(list(groups)[0], str) else "BIGINT"
    return f"""SELECT {group}, {code}, code_rank, n, group_n, coalesce({pct('n', 'group_n')}, 0) AS share FROM (
        SELECT g.{group}, t.{code}, t.code_rank,
               (SELECT count(*) FROM {source} s WHERE s.{group} = g.{group} AND s.{code} = t.{code}) AS n,
               (SELECT count(*) FROM {source} s WHERE s.{group} = g.{group}) AS group_n
        FROM (SELECT CAST(unnest([{', '.join(repr(v) for v in groups)}]) AS {kind}) AS {group}) g, ({top_sql(source, code, k)}) t)"""


AGED = {"aged_groups": f"SELECT *, {bins_sql('patient_age_years', study.AGE_EDGES, study.AGE_LABELS)} AS age_group FROM cleaned"}
BROAD = {
    "broad_groups": f"SELECT *, {bins_sql('patient_age_years', study.BROAD_AGE_EDGES, study.BROAD_AGE_LABELS)} AS age_group FROM cleaned"
}


def _aged(spark, sf_dir):
    return bin_right(cleaned(spark, sf_dir), "patient_age_years", study.AGE_EDGES, study.AGE_LABELS, "age_group")


@query(
    "mechanism_shares_by_age_group",
    cleaned_sql(shares_sql("age_group", study.AGE_LABELS, "injury_mechanism", 6, "aged_groups"), **AGED),
)
def mechanism_shares_by_age_group(spark, sf_dir):
    return rates.share_matrix(_aged(spark, sf_dir), "age_group", "injury_mechanism", 6, study.AGE_LABELS)


@query(
    "mechanism_shares_by_year",
    cleaned_sql(shares_sql("patient_age_years", range(18), "injury_mechanism", 6, "cleaned")),
)
def mechanism_shares_by_year(spark, sf_dir):
    return rates.share_by_grid(cleaned(spark, sf_dir), "patient_age_years", 0, 17, "injury_mechanism", 6)


def dominant_sql(group: str, code: str, source: str) -> str:
    return f"""SELECT {group}, {code}, n, group_n, {pct('n', 'group_n')} AS share FROM (
        SELECT {group}, {code}, n, CAST(sum(n) OVER (PARTITION BY {group}) AS BIGINT) AS group_n,
               row_number() OVER (PARTITION BY {group} ORDER BY {code} IS NULL, n DESC, {code}) AS place
        FROM (SELECT {group}, {code}, count(*) AS n FROM {source} WHERE {group} IS NOT NULL GROUP BY 1, 2))
        WHERE place = 1 AND {code} IS NOT NULL"""


@query(
    "dominant_mechanism_by_stage",
    cleaned_sql(
        dominant_sql("stage", "injury_mechanism", "staged"),
        staged=f"SELECT *, {bands_sql('patient_age_years', study.LIFE_STAGES)} AS stage FROM cleaned",
    ),
)
def dominant_mechanism_by_stage(spark, sf_dir):
    staged = band_left(cleaned(spark, sf_dir), "patient_age_years", study.LIFE_STAGES, "stage")
    return rates.dominant(staged, "stage", "injury_mechanism")


@query("dominant_event_by_user", dominant_sql("user_id", "event_type", "events"))
def dominant_event_by_user(spark, sf_dir):
    return rates.dominant(table(spark, sf_dir, "events"), "user_id", "event_type")


LOC_SQL = f"""SELECT *, rate / nullif(lag(rate) OVER (ORDER BY loss_of_consciousness_duration), 0) AS ratio_to_previous
    FROM ({rates_sql('loss_of_consciousness_duration', 'cleaned', 'all', 'has_loss_of_consciousness_history = 1')})"""


@query("rate_by_loc_duration", cleaned_sql(LOC_SQL))
def rate_by_loc_duration(spark, sf_dir):
    with_loc = equals("has_loss_of_consciousness_history", 1)
    return rates.ordered_rate(cleaned(spark, sf_dir), with_loc, "loss_of_consciousness_duration", OUTCOME)


def _side_share(side: int) -> str:
    n = f"(SELECT count(*) FROM broad_groups s WHERE s.age_group = g.age_group AND s.injury_mechanism = t.injury_mechanism AND s.patient_gender = {side})"
    group_n = f"(SELECT count(*) FROM broad_groups s WHERE s.age_group = g.age_group AND s.patient_gender = {side})"
    return f"{group_n} AS group_n_{side}, coalesce({pct(n, group_n)}, 0) AS share_{side}"


GAP_SQL = f"""SELECT age_group, injury_mechanism, code_rank, group_n_1 AS group_n_n_first, group_n_2 AS group_n_n_second,
    share_1 AS share_first, share_2 AS share_second, share_1 - share_2 AS gap FROM (
    SELECT g.age_group, t.injury_mechanism, t.code_rank, {_side_share(1)}, {_side_share(2)}
    FROM (SELECT unnest([{', '.join(repr(v) for v in study.BROAD_AGE_LABELS)}]) AS age_group) g,
         ({top_sql('broad_groups', 'injury_mechanism', 5)}) t)""".replace("group_n_n_", "group_n_")


def _gaps(spark, sf_dir):
    grouped = bin_right(
        cleaned(spark, sf_dir), "patient_age_years", study.BROAD_AGE_EDGES, study.BROAD_AGE_LABELS, "age_group"
    )
    return rates.gap_table(
        grouped, "patient_gender", (1, 2), "age_group", study.BROAD_AGE_LABELS, "injury_mechanism", 5
    )


@query("mechanism_gap_by_gender", cleaned_sql(GAP_SQL, **BROAD))
def mechanism_gap_by_gender(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(
    "largest_gender_gap_in_adolescents",
    cleaned_sql(
        f"SELECT * FROM ({GAP_SQL}) WHERE age_group = '13-17 years' ORDER BY abs(gap) DESC, code_rank LIMIT 1", **BROAD
    ),
)
def largest_gender_gap_in_adolescents(spark, sf_dir):
    return rates.largest_gap(_gaps(spark, sf_dir), "age_group", "13-17 years")


ALL_CODES = 1 << 62


def matrix_sql(row: str, col: str, cols, k: int, source: str, outcome: str = OUTCOME) -> str:
    """``cols`` are the levels, or a SELECT that finds them."""
    levels = cols if isinstance(cols, str) else f"SELECT unnest([{', '.join(repr(v) for v in cols)}]) AS {col}"
    inside = f"FROM {source} s WHERE s.{row} = t.{row} AND s.{col} = g.{col}"
    return f"""SELECT {row}, {col}, code_rank, n, CASE WHEN n >= 10 THEN coalesce({pct('cases', 'known')}, 0) END AS rate FROM (
        SELECT t.{row}, g.{col}, t.code_rank, (SELECT count(*) {inside}) AS n, (SELECT count({outcome}) {inside}) AS known,
               (SELECT count(*) {inside} AND {outcome} = 1) AS cases
        FROM ({levels}) g, ({top_sql(source, row, k)}) t)"""


MATRIX_SQL = matrix_sql("injury_mechanism", "age_group", study.AGE_LABELS, 10, "aged_groups")


def _matrix(spark, sf_dir):
    return rates.rate_matrix(_aged(spark, sf_dir), "injury_mechanism", "age_group", OUTCOME, study.AGE_LABELS, 10)


@query("rate_matrix_mechanism_age", cleaned_sql(MATRIX_SQL, **AGED))
def rate_matrix_mechanism_age(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(
    "rate_matrix_wide",
    cleaned_sql(
        "SELECT injury_mechanism, "
        + ", ".join(f"max(rate) FILTER (WHERE age_group = '{g}') AS \"{g}\"" for g in study.AGE_LABELS)
        + f" FROM ({MATRIX_SQL}) GROUP BY 1",
        **AGED,
    ),
)
def rate_matrix_wide(spark, sf_dir):
    return rates.widen_matrix(_matrix(spark, sf_dir), "injury_mechanism", "age_group", study.AGE_LABELS, "rate")


@query("hot_mechanism_age_cells", cleaned_sql(f"SELECT * FROM ({MATRIX_SQL}) WHERE rate > 3", **AGED))
def hot_mechanism_age_cells(spark, sf_dir):
    return rates.hot_cells(_matrix(spark, sf_dir), 3)


LANGS = ["en", "es", "de", "fr", "zh"]
LABELLED = {"labelled": "SELECT source, lang, toxic FROM labels JOIN documents USING (doc_id)"}


@query(
    "toxic_rate_by_source_and_language",
    f"WITH labelled AS ({LABELLED['labelled']}) " + matrix_sql("source", "lang", f"SELECT unnest({LANGS!r}) AS lang UNION SELECT lang FROM labelled WHERE lang IS NOT NULL", ALL_CODES, "labelled", "toxic"),
)
def toxic_rate_by_source_and_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labelled = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return rates.rate_matrix(labelled, "source", "lang", "toxic", LANGS, None, all_levels=True)


SCORE_SQL = (
    f"SELECT *, CASE WHEN {T} <= 13 THEN 'HIGH (excluded)' ELSE 'Low (included)' END AS risk FROM"
    f" ({rates_sql(T, 'cleaned', 'known', f'{T} BETWEEN 3 AND 15')})"
)


def _by_score(spark, sf_dir):
    return rates.rate_by_score(cleaned(spark, sf_dir), T, OUTCOME, 3, 15, 13, "HIGH (excluded)", "Low (included)")


@query("rate_by_total_score", cleaned_sql(SCORE_SQL))
def rate_by_total_score(spark, sf_dir):
    return _by_score(spark, sf_dir)


@query(
    "rate_gap_14_15",
    cleaned_sql(
        f"""SELECT max(rate) FILTER (WHERE {T} = 14) AS rate_first, max(rate) FILTER (WHERE {T} = 15) AS rate_second,
        abs(max(rate) FILTER (WHERE {T} = 14) - max(rate) FILTER (WHERE {T} = 15)) AS gap FROM ({SCORE_SQL})"""
    ),
)
def rate_gap_14_15(spark, sf_dir):
    return rates.score_gap(_by_score(spark, sf_dir), T, 14, 15)


OUTCOMES = [OUTCOME, "hospitalized_2plus_nights_head_injury", "neurosurgery_performed", "death_due_to_tbi"]


def _known_rate(outcome: str, where: str) -> str:
    return f"coalesce({pct(count_if(f'{outcome} = 1 AND {where}'), count_if(f'{outcome} IS NOT NULL AND {where}'))}, 0)"


@query(
    "outcomes_by_category",
    cleaned_sql(
        union_rows(
            [
                {
                    "outcome": f"'{o}'",
                    "rate_first": _known_rate(o, "gcs_category = 1"),
                    "rate_second": _known_rate(o, "gcs_category = 2"),
                }
                for o in OUTCOMES
            ],
            "cleaned",
        )
    ),
)
def outcomes_by_category(spark, sf_dir):
    return rates.outcome_compare(cleaned(spark, sf_dir), "gcs_category", (1, 2), OUTCOMES)


PRESENT = {
    "Altered mental status": "has_altered_mental_status = 1",
    "Palpable skull fracture": "has_palpable_skull_fracture = 1",
    "Loss of consciousness": "loss_of_consciousness_duration > 0",
    "Not acting normally": "acting_normal = 0",
    "Severe mechanism": "injury_mechanism_severity > 0",
}


@query(
    "predictor_rates_by_age_group",
    cleaned_sql(
        union_rows(
            [
                {
                    "predictor": f"'{name}'",
                    "n_first": count_if(f"{test} AND patient_age_under_2yr = 1"),
                    "n_second": count_if(f"{test} AND patient_age_under_2yr = 2"),
                    "rate_first": _known_rate(OUTCOME, f"{test} AND patient_age_under_2yr = 1"),
                    "rate_second": _known_rate(OUTCOME, f"{test} AND patient_age_under_2yr = 2"),
                    "difference": _known_rate(OUTCOME, f"{test} AND patient_age_under_2yr = 1")
                    + " - "
                    + _known_rate(OUTCOME, f"{test} AND patient_age_under_2yr = 2"),
                }
                for name, test in PRESENT.items()
            ],
            "cleaned",
        )
    ),
)
def predictor_rates_by_age_group(spark, sf_dir):
    present = {
        "Altered mental status": equals("has_altered_mental_status", 1),
        "Palpable skull fracture": equals("has_palpable_skull_fracture", 1),
        "Loss of consciousness": "loss_of_consciousness_duration > 0",
        "Not acting normally": equals("acting_normal", 0),
        "Severe mechanism": "injury_mechanism_severity > 0",
    }
    return rates.predictor_rates(cleaned(spark, sf_dir), present, study.AGE_GROUP, (1, 2), OUTCOME)


DIMENSIONS = {
    "patient_gender": study.GENDER_LABELS,
    "patient_ethnicity": study.ETHNICITY_LABELS,
    "patient_race": study.RACE_LABELS,
}
DIMENSION_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS dimension, {c} AS level, {labels_sql(c, labels)} AS label, count(*) AS n,
    {_known_rate('head_ct_performed', 'true')} AS num_rate, {_known_rate(OUTCOME, 'true')} AS den_rate
    FROM cleaned WHERE {c} IN {in_list(labels)} GROUP BY {c}"""
    for c, labels in DIMENSIONS.items()
)


@query(
    "ct_use_by_demographics",
    cleaned_sql(f"SELECT *, CASE WHEN den_rate > 0 THEN num_rate / den_rate ELSE 0 END AS ratio FROM ({DIMENSION_SQL})"),
)
def ct_use_by_demographics(spark, sf_dir):
    return rates.dimension_rates(cleaned(spark, sf_dir), DIMENSIONS, "head_ct_performed", OUTCOME)


def risk_sql(signs: dict[str, str], age: str, bands, source: str, outcome: str, where: str = "true") -> str:
    rows = []
    for name, c in signs.items():
        rows.append(
            f"""SELECT b.band, '{name}' AS sign, {count_if(f'{c} = 1')} AS n_pos, {count_if(f'{c} = 0')} AS n_neg,
            {count_if(f'{c} = 1 AND {outcome} = 1')} AS cases_pos, {count_if(f'{c} = 0 AND {outcome} = 1')} AS cases_neg
            FROM (SELECT unnest([{', '.join(repr(x[2]) for x in bands)}]) AS band) b
            LEFT JOIN (SELECT *, {bands_sql(age, bands)} AS band FROM {source} WHERE {where}) s USING (band) GROUP BY b.band"""
        )
    ratio = f"coalesce({pct('cases_pos', 'n_pos')} / nullif({pct('cases_neg', 'n_neg')}, 0), 0)"
    return f"SELECT *, {ratio} AS risk_ratio FROM ({' UNION ALL '.join(rows)})"


FINDING_2 = risk_sql(findings.SIGNS, "patient_age_years", study.RISK_BANDS, "cleaned", OUTCOME, "in_primary_analysis = 1")


@query("risk_ratio_by_sign", cleaned_sql(FINDING_2))
def risk_ratio_by_sign(spark, sf_dir):
    return findings.risk_by_sign(cleaned(spark, sf_dir))


LENGTH_BANDS = [(0, 500, "short"), (500, 2000, "medium"), (2000, None, "long")]


@query(
    "toxic_risk_by_quality",
    "WITH labelled AS (SELECT quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)) "
    + risk_sql({"quality": "quality"}, "n_chars", LENGTH_BANDS, "labelled", "toxic"),
)
def toxic_risk_by_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labelled = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return risk.risk_ratio(labelled, {"quality": "quality"}, "n_chars", LENGTH_BANDS, "toxic")


@query(
    "risk_ratio_stability",
    cleaned_sql(
        f"""SELECT a.band, a.sign, a.risk_ratio AS before, b.risk_ratio AS after, b.risk_ratio - a.risk_ratio AS change
        FROM ({FINDING_2}) a JOIN ({FINDING_2.replace('in_primary_analysis = 1', f'{T} >= 13')}) b ON a.band = b.band AND a.sign = b.sign"""
    ),
)
def risk_ratio_stability(spark, sf_dir):
    """Finding 2 with the population cut at 14 and at 13."""
    return findings.sign_stability(cleaned(spark, sf_dir))


@query(
    "population_stability",
    cleaned_sql(
        f"""SELECT in_primary_analysis, a.n AS before, b.n AS after, b.n - a.n AS change FROM
        (SELECT in_primary_analysis, count(*) AS n FROM cleaned GROUP BY 1) a FULL JOIN
        (SELECT CASE WHEN {T} >= 13 THEN 1 ELSE 0 END AS in_primary_analysis, count(*) AS n FROM cleaned GROUP BY 1) b
        USING (in_primary_analysis)"""
    ),
)
def population_stability(spark, sf_dir):
    totals = settle(cleaned(spark, sf_dir).groupBy(T).agg(F.count(F.lit(1)).alias("n")), "totals")

    def sizes(threshold):
        return flag_at_least(totals, T, threshold, study.PRIMARY_FLAG).groupBy(study.PRIMARY_FLAG).agg(F.sum("n").alias("n"))

    return risk.compare_runs(sizes(14), sizes(13), [study.PRIMARY_FLAG], "n")


YOUNG, OLDER = "patient_age_under_2yr = 1", "patient_age_under_2yr = 2"
METRIC_SQL = {
    "primary population": "CAST(count(*) AS DOUBLE)",
    "outcome rate": pct(CASES, KNOWN),
    "outcome rate, under 2": pct(count_if(f"{OUTCOME} = 1 AND {YOUNG}"), count_if(f"{OUTCOME} IS NOT NULL AND {YOUNG}")),
    "outcome rate, 2 and older": pct(count_if(f"{OUTCOME} = 1 AND {OLDER}"), count_if(f"{OUTCOME} IS NOT NULL AND {OLDER}")),
    "neurosurgery count": f"CAST({count_if('neurosurgery_performed = 1')} AS DOUBLE)",
    "total 15 rate": pct(count_if(f"{T} = 15"), "count(*)"),
    "under 2 share": pct(count_if(YOUNG), "count(*)"),
    "CT rate": pct(count_if("head_ct_performed = 1"), "count(*)"),
    "palpable fracture rate, under 2": pct(count_if(f"has_palpable_skull_fracture = 1 AND {YOUNG}"), count_if(YOUNG)),
    "palpable fracture rate, 2 and older": pct(count_if(f"has_palpable_skull_fracture = 1 AND {OLDER}"), count_if(OLDER)),
    "vomiting rate": pct(count_if("has_vomiting_post_injury = 1"), "count(*)"),
    "altered mental status rate": pct(count_if("has_altered_mental_status = 1"), "count(*)"),
}


@query(
    "compare_with_published",
    cleaned_sql(
        'SELECT metric, "value", lower, upper, tolerance, "value" BETWEEN lower - tolerance AND upper + tolerance AS passed'
        " FROM metrics JOIN published USING (metric)",
        metrics=union_rows(
            [{"metric": f"'{m}'", '"value"': e} for m, e in METRIC_SQL.items()],
            "(SELECT * FROM cleaned WHERE in_primary_analysis = 1)",
        ),
        published=values_cte(["metric", "lower", "upper", "tolerance"], study.PUBLISHED_BOUNDS),
    ),
)
def compare_with_published(spark, sf_dir):
    return findings.compare_with_published(cleaned(spark, sf_dir))


FINDING_1 = f"""SELECT injury_mechanism, n, n_known, cases, rate, {wilson_sql('cases', 'n')},
    {labels_sql('injury_mechanism', study.MECHANISM_LABELS)} AS mechanism,
    CAST(n - min(n) OVER () AS DOUBLE) / nullif(max(n) OVER () - min(n) OVER (), 0) AS relative_size,
    CASE WHEN rate > 3 THEN 'high' WHEN rate > 1.5 THEN 'medium' ELSE 'low' END AS risk_tier
    FROM ({rates_sql('injury_mechanism', 'cleaned', 'all', f'injury_mechanism IN {in_list(study.MECHANISM_LABELS)}')})"""


@query("finding_mechanism_risk", cleaned_sql(FINDING_1))
def finding_mechanism_risk(spark, sf_dir):
    return findings.risk_by_mechanism(cleaned(spark, sf_dir))


@query(
    "finding_loc_duration",
    cleaned_sql(
        f"SELECT *, {labels_sql('loss_of_consciousness_duration', study.LOC_DURATION_LABELS)} AS duration FROM ({LOC_SQL})"
    ),
)
def finding_loc_duration(spark, sf_dir):
    return findings.risk_by_loss_of_consciousness(cleaned(spark, sf_dir))


@query("rate_by_document_source", f"""WITH labelled AS ({LABELLED['labelled']}) {rates_sql('source', 'labelled', 'known', outcome='toxic')}""")
def rate_by_document_source(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    labelled = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return rates.rate_table(labelled.where(one_of("toxic", [0, 1])), "source", "toxic")
