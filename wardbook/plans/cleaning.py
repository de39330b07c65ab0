"""The whole cleaning sequence with its judgment calls as switches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame

from wardbook.operators import cleaning, rules
from wardbook.operators.identifiers import fill_id_gaps
from wardbook.operators.project import apply_types, flag_at_least, null_codes, rename_from_map
from wardbook.operators.repair import (
    Fix,
    repair_category,
    repair_codes,
    repair_dependents,
    repair_implies,
    repair_ratio,
)
from wardbook.operators.validate import observe_rules, observed_report, validate
from wardbook.plans import head_trauma as study
from wardbook.sources import write_cleaned


@dataclass(frozen=True)
class CleanConfig:
    """What cleaning does. The first four fields are the judgment calls.

    ``order_by`` is a unique integer column giving the row order in which
    missing identifiers are filled; without it identifiers are left alone.
    ``keep_codes`` lists columns whose sentinel code is a real value.
    """

    gcs_threshold: int = 14
    impute_gcs: bool = True
    fix_ct_tbi: bool = True
    validate: bool = True
    order_by: str | None = None
    keep_codes: tuple[str, ...] = ()
    mapping: Mapping[str, str] = field(default_factory=lambda: study.NAME_MAPPING)
    missing_code: int = 92

    def with_threshold(self, threshold: int) -> CleanConfig:
        return replace(self, gcs_threshold=threshold)


JUDGMENT_DEFAULTS = {"gcs_threshold": 14, "impute_gcs": True, "fix_ct_tbi": True}


class Cleaned(NamedTuple):
    data: DataFrame
    report: DataFrame | None


def clean(df: DataFrame, config: CleanConfig = CleanConfig(), save_to: str | None = None) -> Cleaned:
    """Clean a raw visit table; the report is there when ``config.validate`` is set.

    With ``save_to`` the cleaned table is written there as parquet and read
    back, and the report is counted by the job that writes it. That is the way
    to start analyses: a filter on
    a table that was not saved is pushed down as a copy of all corrections
    behind the filtered column.

    The order of the steps matters. Out-of-range scores are snapped after the
    total and the category have been derived, so a total lowered below a
    category's range keeps the category it had.
    """
    keep = {*config.keep_codes, *([config.order_by] if config.order_by else [])}
    out = rename_from_map(df, config.mapping)
    out = null_codes(out, [config.missing_code], exclude=keep)
    if config.impute_gcs:
        out = cleaning.impute_from_total(out, study.GCS_PARTS, study.GCS_TOTAL)
    out = cleaning.rederive_total(out, study.GCS_PARTS, study.GCS_TOTAL)
    out = cleaning.rederive_category(out, study.GCS_TOTAL, study.GCS_CATEGORIES, "gcs_category")
    if config.fix_ct_tbi:
        findings = _present(study.FINDING_COLUMNS, out)
        out = cleaning.promote_flag(out, "ct_shows_tbi", findings, "skull_fracture_depressed")
    if config.order_by:
        out = fill_id_gaps(out, "patient_number", config.order_by)
    out = cleaning.fill_when(out, "patient_age_months", "patient_age_years = 0", 0)
    out = apply_types(out, study.COLUMN_TYPES)
    out = cleaning.snap_codes(out, study.GCS_SNAPS, study.GCS_TOTAL)
    out = flag_at_least(out, study.GCS_TOTAL, config.gcs_threshold, study.PRIMARY_FLAG)
    if save_to:
        checks = standard_rules(out) if config.validate else []
        counted, seen = observe_rules(out, checks)
        out = df.sparkSession.read.schema(out.schema).parquet(write_cleaned(counted, save_to))
        return Cleaned(out, observed_report(out, checks, seen) if config.validate else None)
    return Cleaned(out, validate(out, standard_rules(out)) if config.validate else None)


def standard_rules(df: DataFrame) -> list[rules.Rule]:
    """The study's rules over the columns a table has."""
    return [
        *rules.valid_codes({c: codes for c, codes in study.VALID_CODES.items() if c in df.columns}),
        *rules.dependents(present_dependents(df)),
        rules.consistent_ratio("patient_age_months", "patient_age_years", 12),
        rules.category_by_cut("patient_age_years", "patient_age_under_2yr", 2),
        rules.implies("skull_fracture_depressed", "has_palpable_skull_fracture"),
        rules.implies(
            "hospitalized_2plus_nights_with_positive_ct",
            ["hospitalized_2plus_nights_head_injury", "ct_shows_tbi"],
        ),
        rules.implies("head_ct_performed_in_ed", "head_ct_performed"),
    ]


def standard_repair(df: DataFrame) -> list[list[Fix]]:
    """The study's repair stages, in order, over the columns a table has."""
    return [
        repair_codes(study.GCS_SNAPS, study.GCS_TOTAL),
        repair_dependents(present_dependents(df)),
        repair_ratio("patient_age_months", "patient_age_years", 12),
        repair_category("patient_age_years", "patient_age_under_2yr", 2),
        [
            *repair_implies("skull_fracture_depressed", "has_palpable_skull_fracture", "set"),
            *repair_implies(
                "hospitalized_2plus_nights_with_positive_ct",
                ["hospitalized_2plus_nights_head_injury", "ct_shows_tbi"],
                "null",
            ),
            *repair_implies("head_ct_performed_in_ed", "head_ct_performed", "set"),
        ],
    ]


def present_dependents(df: DataFrame, parents: Mapping[str, Sequence[str]] = study.DEPENDENTS) -> dict[str, list[str]]:
    """The parent and detail columns a table has."""
    found = {p: _present(children, df) for p, children in parents.items() if p in df.columns}
    return {p: children for p, children in found.items() if children}


def _present(columns: Sequence[str], df: DataFrame) -> list[str]:
    return [c for c in columns if c in df.columns]
