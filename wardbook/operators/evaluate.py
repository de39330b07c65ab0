"""Confusion metrics, class weights and score thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.numbers import ratio
from wardbook.functions.predicates import all_of, count_if, equals, known, name
from wardbook.operators.project import with_columns
from wardbook.operators.ranking import running_totals
from wardbook.session import settle

RATES = {
    "sensitivity": ratio("tp", "(tp + fn)"),
    "specificity": ratio("tn", "(tn + fp)"),
    "ppv": ratio("tp", "(tp + fp)"),
    "npv": ratio("tn", "(tn + fn)"),
    "accuracy": ratio("(tp + tn)", "(tp + tn + fp + fn)"),
}


def evaluate(
    df: DataFrame, y: str, pred: str, by: str | None = None, count: str | None = None, digits: int | None = None
) -> DataFrame:
    """Confusion counts and rates of a 0/1 prediction, for all rows or per level of ``by``.

    Rows without an outcome or a prediction are left out. ``count`` names a
    column saying how many records a row stands for. A rate with denominator 0 is null.
    """

    def tally(*conditions: str) -> str:
        # The test for known values stays inside the counts: as a filter it
        # would be pushed down as a copy of everything the prediction is made of.
        condition = all_of([known(y), known(pred), *conditions])
        if count is None:
            return count_if(condition)
        return f"CAST(coalesce(sum(CASE WHEN {condition} THEN {name(count)} END), 0) AS BIGINT)"

    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (1, 0), "fn": (0, 1)}
    measures = {"n": tally(), "positives": tally(equals(y, 1))} | {
        cell: tally(equals(pred, p), equals(y, t)) for cell, (p, t) in cells.items()
    }
    counts = (df.groupBy(by) if by else df).agg(*[F.expr(f"{expr} AS {m}") for m, expr in measures.items()])
    if by:
        counts = counts.where("n > 0")
    return with_columns(counts, {m: r if digits is None else f"round({r}, {digits})" for m, r in RATES.items()})


def balanced_weight(df: DataFrame, y: str, out: str) -> DataFrame:
    """Add n / (2 n_c), which gives both classes of a 0/1 outcome the same total weight."""
    sizes = df.selectExpr(
        f"named_struct('ones', {count_if(equals(y, 1))}, 'zeros', {count_if(equals(y, 0))})"
    ).scalar()
    own = f"CASE {name(y)} WHEN 1 THEN __sizes.ones WHEN 0 THEN __sizes.zeros END"
    weighted = df.withColumn("__sizes", sizes)
    return with_columns(weighted, {out: ratio("(__sizes.ones + __sizes.zeros)", f"(2 * ({own}))")}).drop("__sizes")


def _score_counts(df: DataFrame, score: str, y: str, *keys: str) -> DataFrame:
    """Positives and negatives per score (and key)."""
    rows = df.where(all_of([known(score), known(y)])).selectExpr(*keys, f"{name(score)} AS score", f"{name(y)} AS __y")
    return rows.groupBy([c for c in rows.columns if c != "__y"]).agg(
        F.expr("count_if(__y = 1) AS pos"), F.expr("count_if(__y = 0) AS neg")
    )


def threshold_for_sensitivity(df: DataFrame, score: str, y: str, target: float) -> DataFrame:
    """The highest score cut (inclusive) that finds at least the target share of the positives.

    One row: threshold, tp, fp, sensitivity, specificity. Scores are counted and
    the counts written when this is called; the running totals go over distinct
    scores only.
    """
    counts = _score_counts(df, score, y)
    both = {"pos": "all_pos", "neg": "all_neg"}
    curve = running_totals(counts, "score", {"pos": "tp", "neg": "fp"}, descending=True, sizes=both)
    best = curve.selectExpr(
        f"max(CASE WHEN {ratio('tp', 'all_pos')} >= {target}D THEN struct(score, tp, fp) END) AS best",
        "struct(max(all_pos) AS pos, max(all_neg) AS neg) AS s",
    )
    return best.selectExpr(
        "best.score AS threshold",
        "best.tp AS tp",
        "best.fp AS fp",
        f"{ratio('best.tp', 's.pos')} AS sensitivity",
        f"{ratio('(s.neg - best.fp)', 's.neg')} AS specificity",
    )


def cv_threshold(df: DataFrame, key: str, score: str, y: str, target: float, k: int = 5) -> DataFrame:
    """Per fold: the threshold found on the other folds and its metrics on the fold itself.

    A record's fold is its integer key modulo k. Scores are counted per fold
    once; the counts, not the records, are then handed to the k - 1 training
    sets they belong to.
    """
    counts = settle(_score_counts(df, score, y, f"CAST(pmod({name(key)}, {k}) AS INT) AS fold"), "score-counts")
    training = (
        counts.selectExpr(f"explode(filter(sequence(0, {k - 1}), f -> f <> fold)) AS held_out", "score", "pos", "neg")
        .groupBy("held_out", "score")
        .agg(F.expr("sum(pos) AS pos"), F.expr("sum(neg) AS neg"))
    )
    return threshold_per_fold(training, counts, target)


def threshold_per_fold(training: DataFrame, counts: DataFrame, target: float) -> DataFrame:
    """The cut each training set gives and its metrics on the held-out fold.

    ``training`` has (held_out, score, pos, neg), distinct in the first two;
    ``counts`` has (fold, score, pos, neg). The highest cut that finds the
    target share of the training positives is taken.
    """
    curve = running_totals(training, "score", {"pos": "tp"}, "held_out", descending=True, sizes={"pos": "n_pos"})
    # What is broadcast has one row per fold.
    thresholds = curve.groupBy("held_out").agg(
        F.expr(f"max(CASE WHEN {ratio('tp', 'n_pos')} >= {target}D THEN score END) AS threshold")
    )
    cells = {
        "tp": "sum(CASE WHEN score >= threshold THEN pos ELSE 0 END)",
        "tn": "sum(CASE WHEN score >= threshold THEN 0 ELSE neg END)",
        "fp": "sum(CASE WHEN score >= threshold THEN neg ELSE 0 END)",
        "fn": "sum(CASE WHEN score >= threshold THEN 0 ELSE pos END)",
    }
    folds = (
        counts.join(thresholds.hint("broadcast"), counts["fold"] == thresholds["held_out"])
        .groupBy("fold", "threshold")
        .agg(
            F.expr("sum(pos + neg) AS n"),
            F.expr("sum(pos) AS positives"),
            *[F.expr(f"{expr} AS {cell}") for cell, expr in cells.items()],
        )
    )
    return with_columns(folds, {m: RATES[m] for m in ("sensitivity", "specificity")})


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean threshold and metrics over the folds."""
    return folds.selectExpr(
        "count(*) AS n_folds", *[f"avg({c}) AS mean_{c}" for c in ("threshold", "sensitivity", "specificity")]
    )
