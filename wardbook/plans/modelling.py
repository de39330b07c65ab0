"""The modelling population, its three classifiers, and their stability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.operators.decision import apply_rule, predict_at
from wardbook.operators.evaluate import evaluate
from wardbook.operators.filters import drop_missing, restrict
from wardbook.operators.learn import (
    COUNT,
    fit_forest,
    fit_logistic,
    pattern_counts,
    populations,
    predict_logistic,
    score,
    summarise,
)
from wardbook.operators.project import derive_flags
from wardbook.plans import head_trauma as study
from wardbook.session import settle

RULE, LOGISTIC, FOREST = "decision rule", "logistic regression", "random forest"


def model_frame(cleaned: DataFrame) -> DataFrame:
    """The primary population with a known outcome and the predictor flags."""
    known = drop_missing(restrict(cleaned, study.PRIMARY_FLAG), [study.OUTCOME])
    return derive_flags(known, study.PREDICTOR_FLAGS | study.AGE_FLAG)


def model_columns() -> list[str]:
    """All that the three classifiers and their evaluation read."""
    return [*study.MODEL_FEATURES, study.AGE_GROUP, "gcs_category", study.OUTCOME]


def population_counts(cleaned: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Records per model pattern in the population of each threshold, from one pass over the cleaned table, written once."""
    known = derive_flags(drop_missing(cleaned, [study.OUTCOME]), study.PREDICTOR_FLAGS | study.AGE_FLAG)
    return settle(populations(pattern_counts(known, model_columns(), study.GCS_TOTAL), study.GCS_TOTAL, thresholds), "populations")


def predict_rule(frame: DataFrame) -> DataFrame:
    return apply_rule(frame, study.AGE_GROUP, study.RULE_BRANCHES, "prediction")


def rule_metrics(frame: DataFrame) -> DataFrame:
    return evaluate(predict_rule(frame), study.OUTCOME, "prediction")


def rule_stability(cleaned: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Metrics of the rule per population threshold; a threshold that no record reaches has no row."""
    counts = population_counts(cleaned, thresholds)
    return evaluate(predict_rule(counts), study.OUTCOME, "prediction", by="threshold", count=COUNT)


def model_table(patterns: DataFrame, trees: int = 200) -> DataFrame:
    """Metrics of the three classifiers on the pattern counts they were fitted on (see ``pattern_counts``).

    Flags, groups and outcome have few combinations, so nothing here depends on
    the number of records.
    """
    features, y = study.MODEL_FEATURES, study.OUTCOME
    regression = fit_logistic(patterns, features, y, count=COUNT)
    forest = fit_forest(patterns, features, y, trees=trees, count=COUNT)
    predicted = {
        RULE: predict_rule(patterns),
        LOGISTIC: predict_logistic(regression, patterns, features, "prediction"),
        FOREST: predict_at(score(forest, patterns, features, "p"), "p", study.FOREST_THRESHOLD, "prediction"),
    }
    return summarise({name: evaluate(rows, y, "prediction", count=COUNT) for name, rows in predicted.items()})


def stability_report(cleaned: DataFrame, thresholds: Sequence[int], trees: int = 200) -> DataFrame:
    """The model table for each population threshold; the cleaned table is read once for all of them."""
    counts = population_counts(cleaned, thresholds)
    tables = [
        model_table(counts.where(F.col("threshold") == t).drop("threshold"), trees).select(F.lit(t).alias("threshold"), "*")
        for t in thresholds
    ]
    return reduce(DataFrame.unionByName, tables)
