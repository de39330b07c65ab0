"""The study's named findings as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.literals import wide_to_long
from wardbook.functions.numbers import percent
from wardbook.functions.predicates import all_of, equals, known, literal, one_of
from wardbook.operators.filters import restrict
from wardbook.operators.learn import COUNT, pattern_counts, populations
from wardbook.operators.project import label_codes, min_max_scale, tier
from wardbook.operators.rates import ordered_rate, rate_table_ci
from wardbook.operators.risk import compare_runs, reality_check, risk_ratio
from wardbook.operators.validate import wide_counts
from wardbook.plans import head_trauma as study
from wardbook.session import settle

SIGNS = {"Skull Fracture": "has_palpable_skull_fracture", "Vomiting": "has_vomiting_post_injury"}


def risk_by_mechanism(cleaned: DataFrame) -> DataFrame:
    """Outcome rate per injury mechanism with interval, tier and size relative to the other mechanisms."""
    labelled = cleaned.where(one_of("injury_mechanism", study.MECHANISM_LABELS))
    table = rate_table_ci(labelled, "injury_mechanism", study.OUTCOME)
    table = label_codes(table, "injury_mechanism", study.MECHANISM_LABELS, "mechanism")
    table = min_max_scale(table, "n", "relative_size")
    return tier(table, "rate", study.RATE_TIERS, study.RATE_TIER_DEFAULT, "risk_tier")


def risk_by_sign(cleaned: DataFrame, digits: int | None = None) -> DataFrame:
    """Risk ratio of two signs per age band in the primary population."""
    primary = restrict(cleaned, study.PRIMARY_FLAG)
    return risk_ratio(primary, SIGNS, "patient_age_years", study.RISK_BANDS, study.OUTCOME, digits)


def risk_by_loss_of_consciousness(cleaned: DataFrame) -> DataFrame:
    """Outcome rate by duration among visits with loss of consciousness, and the jump from level to level."""
    table = ordered_rate(
        cleaned,
        equals("has_loss_of_consciousness_history", 1),
        "loss_of_consciousness_duration",
        study.OUTCOME,
    )
    return label_codes(table, "loss_of_consciousness_duration", study.LOC_DURATION_LABELS, "duration")


def sign_stability(cleaned: DataFrame, before: int = 14, after: int = 13, digits: int | None = None) -> DataFrame:
    """Risk by sign under two population thresholds, from one pass over the cleaned table."""
    columns = ["patient_age_years", *SIGNS.values(), study.OUTCOME]
    counts = pattern_counts(cleaned, columns, study.GCS_TOTAL)
    counts = settle(populations(counts, study.GCS_TOTAL, (before, after)), "populations")
    runs = [
        risk_ratio(counts.where(F.col("threshold") == t), SIGNS, columns[0], study.RISK_BANDS, study.OUTCOME, digits, COUNT)
        for t in (before, after)
    ]
    return compare_runs(*runs, ["band", "sign"], "risk_ratio")


def study_metrics(cleaned: DataFrame) -> DataFrame:
    """The figures the study compares with the published ones, from one pass over the primary population."""
    young, older = equals(study.AGE_GROUP, 1), equals(study.AGE_GROUP, 2)
    case, palpable = equals(study.OUTCOME, 1), equals("has_palpable_skull_fracture", 1)
    shares = {
        "outcome rate": ([case], [known(study.OUTCOME)]),
        "outcome rate, under 2": ([case, young], [known(study.OUTCOME), young]),
        "outcome rate, 2 and older": ([case, older], [known(study.OUTCOME), older]),
        "total 15 rate": ([equals(study.GCS_TOTAL, 15)], []),
        "under 2 share": ([young], []),
        "CT rate": ([equals("head_ct_performed", 1)], []),
        "palpable fracture rate, under 2": ([palpable, young], [young]),
        "palpable fracture rate, 2 and older": ([palpable, older], [older]),
        "vomiting rate": ([equals("has_vomiting_post_injury", 1)], []),
        "altered mental status rate": ([equals("has_altered_mental_status", 1)], []),
    }
    tests = ["true", equals("neurosurgery_performed", 1), *[all_of(t) for pair in shares.values() for t in pair]]
    values = {"primary population": "CAST(c0 AS DOUBLE)", "neurosurgery count": "CAST(c1 AS DOUBLE)"}
    values |= {metric: percent(f"c{2 * i + 2}", f"c{2 * i + 3}") for i, metric in enumerate(shares)}
    counts = wide_counts(restrict(cleaned, study.PRIMARY_FLAG), tests)
    return wide_to_long(counts, [{"metric": literal(m), "value": value} for m, value in values.items()])


def compare_with_published(cleaned: DataFrame) -> DataFrame:
    return reality_check(study_metrics(cleaned), study.PUBLISHED_BOUNDS)
