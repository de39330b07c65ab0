"""Logistic regression and random forest on 0/1 features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.literals import literal_rows
from wardbook.functions.numbers import ratio
from wardbook.functions.predicates import name
from wardbook.operators.evaluate import threshold_per_fold
from wardbook.operators.forest import ForestFit, cv_forest, cv_forest_threshold, fit_forest, forest_importances, score_forest  # noqa: F401
from wardbook.operators.logistic import COUNT, LogisticFit, fit_logistic_models, folded_counts, scored_counts
from wardbook.session import settle


def pattern_counts(df: DataFrame, features: Sequence[str], *keys: str) -> DataFrame:
    """Records per combination of feature and key values: at most 2^features rows per key for 0/1 features."""
    return df.groupBy(*features, *keys).agg(F.count(F.lit(1)).alias(COUNT))


def populations(counts: DataFrame, total: str, thresholds: Sequence[int]) -> DataFrame:
    """Counts of patterns in every population whose total reaches a threshold: (threshold, the other columns, n).

    ``counts`` has the records per pattern and total (see ``pattern_counts``),
    so any list of thresholds takes one pass over the records. A missing total
    is in no population.
    """
    reached = f"explode(filter(array({', '.join(str(t) for t in thresholds)}), t -> {name(total)} >= t)) AS threshold"
    others = [c for c in counts.columns if c not in (total, COUNT)]
    return counts.selectExpr("*", reached).groupBy("threshold", *others).agg(F.sum(COUNT).alias(COUNT))


def fit_logistic(df: DataFrame, features: Sequence[str], y: str, c: float = 1.0, count: str | None = None) -> LogisticFit:
    """L2 logistic regression with balanced classes and inverse regularisation strength ``c``.

    The fit runs on feature patterns weighted by their counts, which gives the
    same optimum as the single records, so after one aggregate its cost no
    longer depends on the size of the table (see ``fit_logistic_models``).
    """
    return fit_logistic_models(folded_counts(df, features, y, count=count), features, y, [(c, None)])[0]


def score(model: ForestFit, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Add the model's probability of outcome 1."""
    return score_forest(model, df, features, out)


def predict_logistic(model: LogisticFit, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Add the predicted class, cut at probability 0.5."""
    return df.withColumn(out, F.expr(f"CASE WHEN {model.probability(features)} > 0.5D THEN 1 ELSE 0 END"))


def coefficients(model: LogisticFit, features: Sequence[str]) -> DataFrame:
    """Coefficients with their rank (largest first) and direction, and the intercept."""
    ranked = sorted(zip(features, model.coefficients.toArray().tolist()), key=lambda pair: -pair[1])
    directions = {1: "raises", -1: "lowers", 0: "none"}
    rows = [(rank, name, value, directions[(value > 0) - (value < 0)]) for rank, (name, value) in enumerate(ranked, 1)]
    rows.append((None, "intercept", model.intercept, None))
    schema = [("rank", "int"), ("feature", "string"), ("coefficient", "double"), ("direction", "string")]
    return literal_rows(_session(), schema, rows)


def importances(model: ForestFit, features: Sequence[str]) -> DataFrame:
    """Feature importances, largest first."""
    ranked = sorted(forest_importances(model, features), key=lambda pair: -pair[1])
    rows = [(rank, name, value) for rank, (name, value) in enumerate(ranked, 1)]
    return literal_rows(_session(), [("rank", "int"), ("feature", "string"), ("importance", "double")], rows)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def cv_logistic(df: DataFrame, features: Sequence[str], y: str, key: str, strengths: Sequence[float], k: int = 5) -> DataFrame:
    """Cross-validated sensitivity and specificity of the logistic regression for each regularisation strength.

    All models of all folds are fitted together on pattern counts; class weights and
    penalty are those of each training set. The means are over folds.
    """
    counts = folded_counts(df, features, y, key, k)
    fits = fit_logistic_models(counts, features, y, [(c, fold) for c in strengths for fold in range(k)])
    held_out = scored_counts(counts, features, y, fits).where("fold = held_out")
    cells = {"tp": "score > 0.5D THEN pos", "fn": "score <= 0.5D THEN pos", "tn": "score <= 0.5D THEN neg", "fp": "score > 0.5D THEN neg"}
    folds = held_out.groupBy("c", "fold").agg(*[F.expr(f"sum(CASE WHEN {e} ELSE 0 END) AS {cell}") for cell, e in cells.items()])
    return folds.groupBy("c").agg(
        F.expr(f"avg({ratio('tp', '(tp + fn)')}) AS mean_sensitivity"), F.expr(f"avg({ratio('tn', '(tn + fp)')}) AS mean_specificity")
    ).selectExpr("'c' AS parameter", "c AS value", "mean_sensitivity", "mean_specificity")


def cv_model_threshold(df: DataFrame, features: Sequence[str], y: str, key: str, target: float, c: float = 1.0, k: int = 5) -> DataFrame:
    """Per fold: a regression fitted on the other folds, the cut that reaches the target sensitivity there, its metrics on the fold.

    Records are counted per pattern and fold once; a training set is all
    counts but the fold's. Columns as in ``cv_threshold``; ``cv_summary`` gives the means.
    """
    counts = folded_counts(df, features, y, key, k)
    fits = fit_logistic_models(counts, features, y, [(c, fold) for fold in range(k)])
    scored = settle(scored_counts(counts, features, y, fits).select("held_out", "fold", "score", "pos", "neg"), "fold-scores")
    training = scored.where("fold <> held_out").groupBy("held_out", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return threshold_per_fold(training, scored.where("fold = held_out").drop("held_out"), target)


def summarise(model_metrics: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics of several models under one another."""
    tables = [metrics.select(F.lit(name).alias("model"), "*") for name, metrics in model_metrics.items()]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
