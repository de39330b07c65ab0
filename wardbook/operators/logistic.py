"""Balanced logistic regression by reweighted least squares, many models at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.predicates import name
from wardbook.session import settle

FOLD, COUNT = "__fold", "n"
MAX_ROUNDS = 60
STEP = 1e-11  # a round that moves no coefficient by more ends the fit


@dataclass(frozen=True)
class LogisticFit:
    """A fitted model; ``held_out`` is the fold it has not seen, if there is one."""

    coefficients: DenseVector
    intercept: float
    c: float
    held_out: int | None = None

    def probability(self, features: Sequence[str]) -> str:
        """The probability of outcome 1 as SQL text."""
        terms = [f"({w!r}D * {name(f)})" for f, w in zip(features, self.coefficients.toArray().tolist())]
        return f"(1D / (1D + exp(-({' + '.join([f'({self.intercept!r}D)', *terms])}))))"


def folded_counts(df: DataFrame, features: Sequence[str], y: str, key: str | None = None, k: int = 1, count: str | None = None) -> DataFrame:
    """Records per combination of 0/1 features, outcome and fold (the integer key modulo k), written once.

    At most 2^(features + 1) rows per fold. Rows without an outcome are left out.
    A row stands for as many records as its column ``count`` says, if one is named.
    """
    fold = f"CAST(pmod({name(key)}, {k}) AS INT)" if key else "0"
    rows = df.where(f"{name(y)} IS NOT NULL").selectExpr(*[name(c) for c in (*features, y)], f"{fold} AS {FOLD}", f"{name(count) if count else '1L'} AS {COUNT}")
    return settle(rows.groupBy(*features, y, FOLD).agg(F.sum(COUNT).alias(COUNT)), "pattern-counts")


def fit_logistic_models(counts: DataFrame, features: Sequence[str], y: str, settings: Sequence[tuple[float, int | None]]) -> list[LogisticFit]:
    """A model per (c, held-out fold or None), all fitted together on counts of patterns.

    Minimises |w|^2 / 2 + c times the log loss, in which both classes have the
    weight of half the training records; weights and penalty are those of each
    model's own training folds, so a held-out fold has no part in them. The
    intercept is not penalised. Every round is one aggregate over the patterns,
    which sums the normal equations of weighted least squares of all models;
    the driver solves them (as many unknowns as features). A round that makes a
    model's loss larger is taken back by half.
    """
    size = len(features) + 1
    totals = {(r[FOLD], r[y]): r["t"] for r in counts.groupBy(FOLD, y).agg(F.sum(COUNT).alias("t")).collect()}
    weights = []
    for _, held_out in settings:
        zeros, ones = (sum(t for (fold, label), t in totals.items() if label == outcome and fold != held_out) for outcome in (0, 1))
        if not zeros or not ones:
            raise ValueError("both classes are needed to fit a model")
        weights.append(((zeros + ones) / (2 * zeros), (zeros + ones) / (2 * ones)))

    x = ", ".join([*[f"CAST({name(f)} AS DOUBLE)" for f in features], "1D"])
    points = counts.selectExpr(f"array({x}) AS x", f"CAST({name(y)} AS DOUBLE) AS y", COUNT, FOLD)
    # Loss, gradient and Hessian of a pattern one after the other, summed place by place.
    terms = """posexplode(concat(array(weight * (ln(1 + exp(-abs(margin))) + greatest(margin, 0D) - y * margin)),
        transform(x, a -> weight * (p - y) * a), flatten(transform(x, a -> transform(x, b -> weight * p * (1 - p) * a * b)))))"""
    ridge = np.diag([1.0] * (size - 1) + [0.0])
    at = np.zeros((len(settings), size))
    good = at.copy()  # the last coefficients that lowered the loss
    best, open_ = np.full(len(settings), np.inf), set(range(len(settings)))
    for _ in range(MAX_ROUNDS):
        models = ", ".join(_model(m, settings[m][1], weights[m], at[m]) for m in sorted(open_))
        rows = points.selectExpr("*", f"explode(array({models})) AS m").where(f"m.held_out IS NULL OR m.held_out <> {FOLD}")
        rows = rows.selectExpr("m.id AS model", "x", "y", f"{COUNT} * CASE y WHEN 1 THEN m.ones ELSE m.zeros END AS weight", "aggregate(zip_with(x, m.w, (a, b) -> a * b), 0D, (s, t) -> s + t) AS margin")
        rows = rows.selectExpr("*", "1D / (1D + exp(-margin)) AS p").selectExpr("model", terms)
        sums = np.zeros((len(settings), 1 + size + size * size))
        for r in rows.groupBy("model", "pos").agg(F.sum("col").alias("total")).collect():
            sums[r["model"], r["pos"]] = r["total"]
        for m in sorted(open_):
            c = settings[m][0]
            loss = c * sums[m, 0] + at[m] @ ridge @ at[m] / 2
            if loss > best[m] * (1 + 1e-12):
                at[m] = (at[m] + good[m]) / 2
                continue
            best[m], good[m] = loss, at[m]
            gradient = c * sums[m, 1 : 1 + size] + ridge @ at[m]
            hessian = c * sums[m, 1 + size :].reshape(size, size) + ridge
            step = np.linalg.solve(hessian, gradient)
            at[m] = at[m] - step
            if np.abs(step).max() <= STEP:
                open_.discard(m)
        if not open_:
            break
    return [LogisticFit(DenseVector(w[:-1]), float(w[-1]), c, held_out) for w, (c, held_out) in zip(at, settings)]


def _model(number: int, held_out: int | None, weights: tuple[float, float], w: np.ndarray) -> str:
    fold = "CAST(NULL AS INT)" if held_out is None else str(held_out)
    values = ", ".join(f"{v!r}D" for v in w.tolist())
    return f"named_struct('id', {number}, 'held_out', {fold}, 'zeros', {weights[0]!r}D, 'ones', {weights[1]!r}D, 'w', array({values}))"


def scored_counts(counts: DataFrame, features: Sequence[str], y: str, fits: Sequence[LogisticFit], digits: int = 9) -> DataFrame:
    """(model, c, held_out, fold, score, pos, neg): each model's scores on all folds, with the records of both outcomes.

    Scores are rounded, so that patterns of equal score are told apart by no rounding error.
    """
    scores = ", ".join(
        f"named_struct('model', {i}, 'c', {fit.c!r}D, 'held_out', {fit.held_out if fit.held_out is not None else 'CAST(NULL AS INT)'}, 'score', round({fit.probability(features)}, {digits}))"
        for i, fit in enumerate(fits)
    )
    rows = counts.selectExpr(f"inline(array({scores}))", f"{FOLD} AS fold", f"{name(y)} AS y", COUNT)
    return rows.groupBy("model", "c", "held_out", "fold", "score").agg(
        F.expr(f"sum(CASE WHEN y = 1 THEN {COUNT} ELSE 0 END) AS pos"), F.expr(f"sum(CASE WHEN y = 0 THEN {COUNT} ELSE 0 END) AS neg")
    )
