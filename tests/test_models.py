"""Learned models against independent solutions."""

from __future__ import annotations

import numpy as np
import pytest

from catalog.base import KEY, cleaned
from wardbook.operators import forest, learn
from wardbook.operators.decision import predict_at
from wardbook.operators.evaluate import evaluate
from wardbook.plans import head_trauma as study
from wardbook.plans.modelling import model_frame, stability_report

FEATURES, Y = study.MODEL_FEATURES, study.OUTCOME


@pytest.fixture(scope="module")
def frame(spark, sf_dir):
    return model_frame(cleaned(spark, sf_dir)).select(KEY, *FEATURES, Y).cache()


def newton(x, y, c):
    """Minimum of |w|^2 / 2 + c * sum of balanced log losses, intercept free."""
    n, ones = len(y), y.sum()
    weights = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    design = np.hstack([x, np.ones((n, 1))])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = c * design.T @ (weights * (p - y)) + ridge @ w
        hessian = c * (design.T * (weights * p * (1 - p))) @ design + ridge
        w = w - np.linalg.solve(hessian, gradient)
    return w


@pytest.mark.parametrize("c", [1.0, 0.1])
def test_regression_equals_the_exact_optimum(frame, c):
    data = np.array([tuple(r) for r in frame.select(*FEATURES, Y).collect()], dtype=float)
    expected = newton(data[:, :-1], data[:, -1], c)
    model = learn.fit_logistic(frame, FEATURES, Y, c)
    got = np.append(model.coefficients.toArray(), model.intercept)
    assert np.abs(got - expected).max() < 1e-5

    ranked = learn.coefficients(model, FEATURES).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["coefficient"] for r in ranked] == sorted(model.coefficients.toArray(), reverse=True)
    scores = 1 / (1 + np.exp(-(data[:, :-1] @ expected[:-1] + expected[-1])))
    predicted = learn.predict_logistic(model, frame, FEATURES, "p").agg({"p": "sum"}).first()[0]
    assert predicted == (scores > 0.5).sum()


def test_one_class_is_refused(frame):
    with pytest.raises(ValueError):
        learn.fit_logistic(frame.where(f"{Y} = 0"), FEATURES, Y)


def test_forest_ranks_cases_above_others(frame):
    model = learn.fit_forest(frame, FEATURES, Y, trees=30)
    scored = learn.score(model, frame, FEATURES, "p")
    row = evaluate(predict_at(scored, "p", study.FOREST_THRESHOLD, "pred"), Y, "pred").first()
    assert row["sensitivity"] > 0.6
    averages = {r[Y]: r["m"] for r in scored.groupBy(Y).agg({"p": "avg"}).toDF(Y, "m").collect()}
    assert averages[1] > averages[0]
    importance = learn.importances(model, FEATURES).collect()
    assert len(importance) == 11 and sum(r["importance"] for r in importance) == pytest.approx(1)
    again = learn.score(learn.fit_forest(frame, FEATURES, Y, trees=30), frame, FEATURES, "p")
    assert again.agg({"p": "sum"}).first() == scored.agg({"p": "sum"}).first()


def test_sweeps_return_one_row_per_value(frame):
    strengths = learn.cv_logistic(frame, FEATURES, Y, KEY, [0.1, 1.0], k=2).orderBy("value").collect()
    assert [r["value"] for r in strengths] == [0.1, 1.0]
    leaves = learn.cv_forest(frame, FEATURES, Y, KEY, [5, 20], k=2, trees=3).orderBy("value").collect()
    assert [r["value"] for r in leaves] == [5, 20]
    assert all(0 <= r["mean_sensitivity"] <= 1 for r in strengths + leaves)


def test_stability_report(spark, sf_dir):
    rows = stability_report(cleaned(spark, sf_dir), [14, 13], trees=5).collect()
    assert len(rows) == 6
    sizes = {r["threshold"]: r["n"] for r in rows}
    assert sizes[13] >= sizes[14]
    for r in rows:
        assert r["tp"] + r["tn"] + r["fp"] + r["fn"] == r["n"]


def test_nested_threshold_against_numpy(frame):
    """Model and cut of every fold come from the other folds alone."""
    data = np.array([tuple(r) for r in frame.select(KEY, *FEATURES, Y).collect()], dtype=float)
    key, x, y = data[:, 0].astype(int), data[:, 1:-1], data[:, -1]
    got = {r["fold"]: r for r in learn.cv_model_threshold(frame, FEATURES, Y, KEY, 0.9, k=3).collect()}
    assert set(got) == {0, 1, 2}
    for fold, row in got.items():
        train = key % 3 != fold
        w = newton(x[train], y[train], 1.0)
        scores = np.round(1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))), 9)
        positives = np.sort(scores[train & (y == 1)])[::-1]
        cut = positives[int(np.ceil(0.9 * len(positives))) - 1]
        assert row["threshold"] == pytest.approx(cut, abs=2e-9)
        held = ~train
        assert row["tp"] == ((scores >= cut - 2e-9) & held & (y == 1)).sum()
        assert row["fp"] == ((scores >= cut - 2e-9) & held & (y == 0)).sum()


def test_models_fitted_together_equal_single_fits(frame):
    counts = learn.folded_counts(frame, FEATURES, Y, KEY, 3)
    settings = [(0.01, None), (10.0, 0), (1.0, 2)]
    together = learn.fit_logistic_models(counts, FEATURES, Y, settings)
    for setting, fit in zip(settings, together):
        alone = learn.fit_logistic_models(counts, FEATURES, Y, [setting])[0]
        assert np.abs(fit.coefficients.toArray() - alone.coefficients.toArray()).max() < 1e-9
        assert (fit.c, fit.held_out) == setting


def test_forest_depends_on_neither_partitions_nor_order(spark, frame):
    rows = frame.select(*FEATURES, Y)
    few = learn.fit_forest(rows.repartition(2), FEATURES, Y, trees=15)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        many = learn.fit_forest(rows.repartition(16), FEATURES, Y, trees=15)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert few.nodes.equals(many.nodes)
    assert forest.forest_importances(few, FEATURES) == forest.forest_importances(many, FEATURES)


def test_forest_nodes(frame):
    model = learn.fit_forest(frame, FEATURES, Y, trees=10, min_leaf=25)
    data = frame.select(*FEATURES, Y).toPandas()
    bits = sum(data[f].to_numpy().astype(np.int64) << i for i, f in enumerate(FEATURES))
    scored = learn.score(model, frame, FEATURES, "p").select("p").toPandas()["p"]
    assert sorted(scored.round(12)) == sorted(model.values(bits).round(12))
    # Bags hold as many records as the table, but for chance; both classes weigh the same.
    roots = model.nodes[model.nodes["node"] == 0]
    assert abs(roots["weight"].mean() / len(data) - 1) < 0.05 and roots["p"].between(0.499, 0.501).all()
    inner = model.nodes[model.nodes["feature"] >= 0]
    assert (inner["gain"] >= -1e-9).all() and len(inner) > 30


def test_forest_threshold_reaches_its_target_on_training_folds(frame):
    rows = forest.cv_forest_threshold(frame, FEATURES, Y, KEY, 0.9, k=3, trees=10).collect()
    assert {r["fold"] for r in rows} == {0, 1, 2}
    assert all(0 < r["threshold"] < 1 and r["tp"] + r["fn"] == r["positives"] for r in rows)
