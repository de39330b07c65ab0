"""Modelling population, decision rule, learned models, evaluation and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, cleaned, query, table
from catalog.oracle import OUTCOME, T, cleaned_sql, count_if, div
from catalog.project_queries import FLAGS_SQL
from wardbook.operators import evaluate, forest, learn
from wardbook.operators.decision import apply_rule, predict_at, rule_reason
from wardbook.plans import head_trauma as study
from wardbook.plans.modelling import model_frame, rule_metrics, rule_stability, stability_report

FEATURES = study.MODEL_FEATURES
FLAG_COLUMNS = ", ".join(f"{sql} AS {name}" for name, sql in FLAGS_SQL.items())


def frame_sql(threshold: int = 14) -> str:
    return (
        f"SELECT *, {FLAG_COLUMNS}, CASE WHEN patient_age_under_2yr = 1 THEN 1 ELSE 0 END AS is_under_2"
        f" FROM cleaned WHERE {T} >= {threshold} AND {OUTCOME} IS NOT NULL"
    )


FRAME = {"frame": frame_sql()}
UNDER, OVER = study.RULE_BRANCHES[1], study.RULE_BRANCHES[2]


def _any_sql(tests) -> str:
    return "(CASE WHEN " + " OR ".join(f"{c} = {code}" for c, code in tests) + " THEN 1 ELSE 0 END)"


def _first_sql(tests) -> str:
    return "(CASE " + " ".join(f"WHEN {c} = {code} THEN '{c}'" for c, code in tests) + " END)"


PREDICTION = f"CASE patient_age_under_2yr WHEN 1 THEN {_any_sql(UNDER)} WHEN 2 THEN {_any_sql(OVER)} END"
REASON = f"CASE patient_age_under_2yr WHEN 1 THEN {_first_sql(UNDER)} WHEN 2 THEN {_first_sql(OVER)} END"


def metrics_sql(y: str, pred: str, source: str, by: str | None = None) -> str:
    tp, tn = count_if(f"{pred} = 1 AND {y} = 1"), count_if(f"{pred} = 0 AND {y} = 0")
    fp, fn = count_if(f"{pred} = 1 AND {y} = 0"), count_if(f"{pred} = 0 AND {y} = 1")
    return f"""SELECT {f'{by}, ' if by else ''}count(*) AS n, {count_if(f'{y} = 1')} AS positives, {tp} AS tp, {tn} AS tn, {fp} AS fp, {fn} AS fn,
    {div(tp, f'({tp} + {fn})')} AS sensitivity, {div(tn, f'({tn} + {fp})')} AS specificity, {div(tp, f'({tp} + {fp})')} AS ppv,
    {div(tn, f'({tn} + {fn})')} AS npv, {div(f'({tp} + {tn})', f'({tp} + {tn} + {fp} + {fn})')} AS accuracy
    FROM {source} WHERE {y} IS NOT NULL AND {pred} IS NOT NULL{f' GROUP BY {by}' if by else ''}"""


def _frame(spark, sf_dir):
    return model_frame(cleaned(spark, sf_dir))


@query("modelling_population", cleaned_sql(f"SELECT event_id, {OUTCOME}, {', '.join(FEATURES)} FROM frame", **FRAME))
def modelling_population(spark, sf_dir):
    return _frame(spark, sf_dir).select(KEY, OUTCOME, *FEATURES)


@query("decision_rule", cleaned_sql(f"SELECT event_id, {PREDICTION} AS prediction FROM frame", **FRAME))
def decision_rule(spark, sf_dir):
    predicted = apply_rule(_frame(spark, sf_dir), study.AGE_GROUP, study.RULE_BRANCHES, "prediction")
    return predicted.select(KEY, "prediction")


@query("decision_rule_reason", cleaned_sql(f"SELECT event_id, {REASON} AS reason FROM frame", **FRAME))
def decision_rule_reason(spark, sf_dir):
    explained = rule_reason(_frame(spark, sf_dir), study.AGE_GROUP, study.RULE_BRANCHES, "reason")
    return explained.select(KEY, "reason")


PREDICTED = {"predicted": f"SELECT *, {PREDICTION} AS prediction FROM frame"}


@query("decision_rule_metrics", cleaned_sql(metrics_sql(OUTCOME, "prediction", "predicted"), **FRAME, **PREDICTED))
def decision_rule_metrics(spark, sf_dir):
    return rule_metrics(_frame(spark, sf_dir))


@query(
    "decision_rule_metrics_by_age_group",
    cleaned_sql(metrics_sql(OUTCOME, "prediction", "predicted", "patient_age_under_2yr"), **FRAME, **PREDICTED),
)
def decision_rule_metrics_by_age_group(spark, sf_dir):
    predicted = apply_rule(_frame(spark, sf_dir), study.AGE_GROUP, study.RULE_BRANCHES, "prediction")
    return evaluate.evaluate(predicted, OUTCOME, "prediction", by=study.AGE_GROUP)


@query(
    "decision_rule_stability",
    cleaned_sql(
        f"SELECT 14 AS threshold, * FROM ({metrics_sql(OUTCOME, 'prediction', 'predicted')}) UNION ALL"
        f" SELECT 13 AS threshold, * FROM ({metrics_sql(OUTCOME, 'prediction', 'wider_predicted')})",
        **FRAME,
        **PREDICTED,
        wider=frame_sql(13),
        wider_predicted=f"SELECT *, {PREDICTION} AS prediction FROM wider",
    ),
)
def decision_rule_stability(spark, sf_dir):
    """The rule on the population cut at 14 and at 13."""
    return rule_stability(cleaned(spark, sf_dir), [14, 13])


@query("label_agreement", metrics_sql("toxic", "quality", "labels"))
def label_agreement(spark, sf_dir):
    """Confusion metrics of one label taken as the prediction of the other."""
    return evaluate.evaluate(table(spark, sf_dir, "labels"), "toxic", "quality")


@query(
    "balanced_weights",
    cleaned_sql(
        f"""SELECT event_id, CAST(n AS DOUBLE) / (2 * CASE WHEN {OUTCOME} = 1 THEN ones ELSE n - ones END) AS weight
        FROM frame, (SELECT count(*) AS n, {count_if(f'{OUTCOME} = 1')} AS ones FROM frame)""",
        **FRAME,
    ),
)
def balanced_weights(spark, sf_dir):
    return evaluate.balanced_weight(_frame(spark, sf_dir), OUTCOME, "weight").select(KEY, "weight")


RISK_POINTS = (
    "4 * has_altered_mental_status + 3 * coalesce(has_palpable_skull_fracture, 0)"
    " + 6 * has_basilar_skull_fracture_signs + coalesce(has_vomiting_post_injury, 0) + coalesce(injury_mechanism_severity, 0)"
)
SCORED = {"scored": f"SELECT *, {RISK_POINTS} AS points FROM frame"}


def _scored(spark, sf_dir):
    """A point score SQL can compute too, standing in for a model's probability."""
    return _frame(spark, sf_dir).withColumn("points", F.expr(RISK_POINTS))


@query(
    "predict_at_threshold",
    cleaned_sql("SELECT event_id, CASE WHEN points >= 3 THEN 1 ELSE 0 END AS prediction FROM scored", **FRAME, **SCORED),
)
def predict_at_threshold(spark, sf_dir):
    return predict_at(_scored(spark, sf_dir), "points", 3, "prediction").select(KEY, "prediction")


def threshold_sql(score: str, y: str, source: str, target: str) -> str:
    return f"""WITH curve AS (SELECT {score} AS s, CAST(sum(pos) OVER (ORDER BY {score} DESC) AS BIGINT) AS tp,
        CAST(sum(neg) OVER (ORDER BY {score} DESC) AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS q
        FROM (SELECT {score}, {count_if(f'{y} = 1')} AS pos, {count_if(f'{y} = 0')} AS neg FROM {source}
              WHERE {score} IS NOT NULL AND {y} IS NOT NULL GROUP BY {score}))
    SELECT s AS threshold, tp, fp, {div('tp', 'p')} AS sensitivity, {div('(q - fp)', 'q')} AS specificity
    FROM curve WHERE {div('tp', 'p')} >= {target} ORDER BY s DESC LIMIT 1"""


@query("threshold_for_sensitivity", cleaned_sql(f"SELECT * FROM ({threshold_sql('points', OUTCOME, 'scored', '0.6e0')})", **FRAME, **SCORED))
def threshold_for_sensitivity(spark, sf_dir):
    return evaluate.threshold_for_sensitivity(_scored(spark, sf_dir), "points", OUTCOME, 0.6)


LENGTHS = "(SELECT n_chars, toxic FROM labels JOIN documents USING (doc_id))"


@query("length_threshold_for_toxicity", threshold_sql("n_chars", "toxic", LENGTHS, "0.95e0"))
def length_threshold_for_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labelled = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return evaluate.threshold_for_sensitivity(labelled, "n_chars", "toxic", 0.95)


def cv_sql(score: str, y: str, key: str, target: str, k: int = 5) -> dict[str, str]:
    """Per held-out fold the threshold from the other folds, then the metrics of the fold."""
    tp, fn = count_if(f"{score} >= threshold AND {y} = 1"), count_if(f"{score} < threshold AND {y} = 1")
    fp, tn = count_if(f"{score} >= threshold AND {y} = 0"), count_if(f"{score} < threshold AND {y} = 0")
    return {
        "folded": f"SELECT {score}, {y}, CAST({key} % {k} AS INTEGER) AS fold FROM scored",
        "training": f"SELECT h.held_out, f.{score}, f.{y} FROM folded f, (SELECT unnest(range({k})) AS held_out) h WHERE f.fold <> h.held_out",
        "curve": f"""SELECT held_out, {score}, sum(pos) OVER (PARTITION BY held_out ORDER BY {score} DESC) AS tp,
            sum(pos) OVER (PARTITION BY held_out) AS p FROM
            (SELECT held_out, {score}, {count_if(f'{y} = 1')} AS pos FROM training GROUP BY held_out, {score})""",
        "chosen": f"SELECT held_out, max({score}) AS threshold FROM curve WHERE {div('tp', 'p')} >= {target} GROUP BY held_out",
        "folds": f"""SELECT fold, threshold, count(*) AS n, {count_if(f'{y} = 1')} AS positives, {tp} AS tp, {tn} AS tn, {fp} AS fp, {fn} AS fn,
            {div(tp, f'({tp} + {fn})')} AS sensitivity, {div(tn, f'({tn} + {fp})')} AS specificity
            FROM folded JOIN chosen ON fold = held_out GROUP BY fold, threshold""",
    }


CV = cv_sql("points", OUTCOME, "event_id", "0.6e0")


@query("cv_threshold", cleaned_sql("SELECT * FROM folds", **FRAME, **SCORED, **CV))
def cv_threshold(spark, sf_dir):
    return evaluate.cv_threshold(_scored(spark, sf_dir), KEY, "points", OUTCOME, 0.6)


@query(
    "cv_threshold_mean",
    cleaned_sql(
        """SELECT count(*) AS n_folds, avg(threshold) AS mean_threshold, round(avg(sensitivity), 9) AS mean_sensitivity,
        round(avg(specificity), 9) AS mean_specificity FROM folds""",
        **FRAME,
        **SCORED,
        **CV,
    ),
)
def cv_threshold_mean(spark, sf_dir):
    """Means over the folds; nine digits, as the order of additions differs between engines."""
    means = evaluate.cv_summary(evaluate.cv_threshold(_scored(spark, sf_dir), KEY, "points", OUTCOME, 0.6))
    return means.withColumns({c: F.round(c, 9) for c in ("mean_sensitivity", "mean_specificity")})


NEWTON_ROUNDS = 9


def fits_sql(settings, k: int = 5) -> dict[str, str]:
    """Newton's method for logistic models (c, held-out fold), unrolled; ``fitted`` has (model, c, held_out, w).

    Each round sums the normal equations per model and eliminates one unknown
    after the other; the equations are positive definite, so no row is exchanged.
    """
    size = len(FEATURES) + 1
    unknowns = range(1, size + 1)
    steps = {
        "pats": f"""SELECT [{", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)}, 1e0] AS x, {OUTCOME} AS y,
            CAST(event_id % {k} AS INTEGER) AS fold, count(*) AS n FROM frame GROUP BY ALL""",
        "models": "SELECT * FROM (VALUES "
        + ", ".join(f"({i}, {c!r}e0, {'CAST(NULL AS INTEGER)' if f is None else f})" for i, (c, f) in enumerate(settings))
        + ") AS t(model, c, held_out)",
        "train": """SELECT model, c, x, y, n * CASE y WHEN 1 THEN total / (2 * ones) ELSE total / (2 * (total - ones)) END AS wt FROM (
            SELECT model, c, x, y, n, CAST(sum(n) OVER (PARTITION BY model) AS DOUBLE) AS total,
                CAST(sum(n * y) OVER (PARTITION BY model) AS DOUBLE) AS ones
            FROM pats, models WHERE held_out IS NULL OR fold <> held_out)""",
        "w0": f"SELECT model, list_transform(range({size}), lambda i: 0e0) AS w FROM models",
    }
    for r in range(NEWTON_ROUNDS):
        sums = ", ".join(f"sum(c * wt * p * (1 - p) * x[i] * x[{j}]) + CASE WHEN i = {j} AND i < {size} THEN 1 ELSE 0 END" for j in unknowns)
        steps[f"e{r}_0"] = f"""SELECT model, i, [{sums}, sum(c * wt * (p - y) * x[i]) + CASE WHEN i < {size} THEN any_value(w[i]) ELSE 0 END] AS r
            FROM (SELECT model, c, x, y, wt, w, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM train JOIN w{r} USING (model)),
            (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY model, i"""
        for j in unknowns:
            steps[f"e{r}_{j}"] = f"""SELECT a.model, a.i, CASE WHEN a.i = {j} THEN list_transform(a.r, lambda v: v / a.r[{j}])
                ELSE list_transform(list_zip(a.r, p.r), lambda z: z[1] - a.r[{j}] / p.r[{j}] * z[2]) END AS r
                FROM e{r}_{j - 1} a JOIN e{r}_{j - 1} p ON a.model = p.model AND p.i = {j}"""
        steps[f"w{r + 1}"] = f"SELECT model, list(w[i] - r[{size + 1}] ORDER BY i) AS w FROM e{r}_{size} JOIN w{r} USING (model) GROUP BY model"
    return steps | {"fitted": f"SELECT model, c, held_out, w FROM models JOIN w{NEWTON_ROUNDS} USING (model)"}


POINT = f"[{', '.join(f'CAST({f} AS DOUBLE)' for f in FEATURES)}, 1e0]"
FITTED = fits_sql([(1.0, None)])
CHOSEN = {"chosen": f"SELECT *, CASE WHEN list_dot_product({POINT}, w) > 0 THEN 1 ELSE 0 END AS prediction FROM frame, fitted"}


@query("logistic_metrics", cleaned_sql(metrics_sql(OUTCOME, "prediction", "chosen"), **FRAME, **FITTED, **CHOSEN))
def logistic_metrics(spark, sf_dir):
    frame = _frame(spark, sf_dir)
    model = learn.fit_logistic(frame, FEATURES, OUTCOME)
    patterns = learn.pattern_counts(frame, FEATURES, OUTCOME)
    predicted = learn.predict_logistic(model, patterns, FEATURES, "prediction")
    return evaluate.evaluate(predicted, OUTCOME, "prediction", count=learn.COUNT)


@query("logistic_predictions", cleaned_sql("SELECT event_id, prediction FROM chosen", **FRAME, **FITTED, **CHOSEN))
def logistic_predictions(spark, sf_dir):
    frame = _frame(spark, sf_dir)
    model = learn.fit_logistic(frame, FEATURES, OUTCOME)
    return learn.predict_logistic(model, frame.select(KEY, *FEATURES), FEATURES, "prediction").select(KEY, "prediction")


@query(
    "logistic_coefficients",
    cleaned_sql(
        f"""SELECT CASE WHEN i <= {len(FEATURES)} THEN CAST(row_number() OVER (ORDER BY i > {len(FEATURES)}, w[i] DESC) AS INTEGER) END AS rank,
        ({FEATURES + ["intercept"]!r})[i] AS feature, round(w[i], 6) AS coefficient,
        CASE WHEN i > {len(FEATURES)} THEN NULL WHEN w[i] > 0 THEN 'raises' WHEN w[i] < 0 THEN 'lowers' ELSE 'none' END AS direction
        FROM fitted, (SELECT unnest(range(1, {len(FEATURES) + 2})) AS i)""",
        **FRAME,
        **FITTED,
    ),
)
def logistic_coefficients(spark, sf_dir):
    """Coefficients to six digits, as the order of additions differs between engines."""
    found = learn.coefficients(learn.fit_logistic(_frame(spark, sf_dir), FEATURES, OUTCOME), FEATURES)
    return found.withColumn("coefficient", F.round("coefficient", 6))


STRENGTHS = [0.01, 0.1, 1.0, 10.0]
SWEPT = fits_sql([(c, fold) for c in STRENGTHS for fold in range(5)])
HIT = "(list_dot_product(x, w) > 0)"


@query(
    "logistic_strength_sweep",
    cleaned_sql(
        f"""SELECT 'c' AS parameter, c AS value, round(avg({div('tp', 'pos')}), 9) AS mean_sensitivity,
        round(avg({div('tn', 'neg')}), 9) AS mean_specificity FROM (
            SELECT c, fold, sum(CASE WHEN y = 1 AND {HIT} THEN n ELSE 0 END) AS tp, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS pos,
                sum(CASE WHEN y = 0 AND NOT {HIT} THEN n ELSE 0 END) AS tn, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS neg
            FROM pats JOIN fitted ON fold = held_out GROUP BY c, fold) GROUP BY c""",
        **FRAME,
        **SWEPT,
    ),
)
def logistic_strength_sweep(spark, sf_dir):
    swept = learn.cv_logistic(_frame(spark, sf_dir), FEATURES, OUTCOME, KEY, STRENGTHS)
    return swept.withColumns({c: F.round(c, 9) for c in ("mean_sensitivity", "mean_specificity")})


def nested_sql(target: str) -> dict[str, str]:
    """Per fold: a model of the other folds, the cut found there, and the counts on the fold."""
    score = "round(1 / (1 + exp(-list_dot_product(x, w))), 9)"
    cells = {"tp": "s >= threshold AND y = 1", "tn": "s < threshold AND y = 0", "fp": "s >= threshold AND y = 0", "fn": "s < threshold AND y = 1"}
    counts = ", ".join(f"CAST(sum(CASE WHEN {e} THEN n ELSE 0 END) AS BIGINT) AS {cell}" for cell, e in cells.items())
    return {
        "scores": f"SELECT held_out, fold, {score} AS s, y, n FROM pats, fitted",
        "curve": """SELECT held_out, s, sum(pos) OVER (PARTITION BY held_out ORDER BY s DESC) AS tp, sum(pos) OVER (PARTITION BY held_out) AS p
            FROM (SELECT held_out, s, sum(n * y) AS pos FROM scores WHERE fold <> held_out GROUP BY held_out, s)""",
        "cuts": f"SELECT held_out, max(s) AS threshold FROM curve WHERE {div('tp', 'p')} >= {target} GROUP BY held_out",
        "folds": f"""SELECT fold, threshold, n, positives, tp, tn, fp, fn, {div('tp', '(tp + fn)')} AS sensitivity, {div('tn', '(tn + fp)')} AS specificity
            FROM (SELECT fold, threshold, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * y) AS BIGINT) AS positives, {counts}
                  FROM scores JOIN cuts USING (held_out) WHERE fold = held_out GROUP BY fold, threshold)""",
    }


NESTED = fits_sql([(1.0, fold) for fold in range(5)]) | nested_sql("0.95e0")


@query("cv_model_threshold", cleaned_sql("SELECT * FROM folds", **FRAME, **NESTED))
def cv_model_threshold(spark, sf_dir):
    return learn.cv_model_threshold(_frame(spark, sf_dir), FEATURES, OUTCOME, KEY, 0.95)


@query(
    "cv_model_threshold_mean",
    cleaned_sql(
        """SELECT count(*) AS n_folds, round(avg(threshold), 8) AS mean_threshold, round(avg(sensitivity), 9) AS mean_sensitivity,
        round(avg(specificity), 9) AS mean_specificity FROM folds""",
        **FRAME,
        **NESTED,
    ),
)
def cv_model_threshold_mean(spark, sf_dir):
    means = evaluate.cv_summary(learn.cv_model_threshold(_frame(spark, sf_dir), FEATURES, OUTCOME, KEY, 0.95))
    return means.withColumns({c: F.round(c, 8 if c == "mean_threshold" else 9) for c in means.columns if c != "n_folds"})


def tree_sql(depth: int, min_leaf: int) -> dict[str, str]:
    """One tree over all records and features, level by level; ``tree`` has a row per node."""
    gini = "2 * ({w1}) * (({w}) - ({w1})) / ({w})"
    gain = f"{gini.format(w='w', w1='w1')} - {gini.format(w='wr', w1='wr1')} - {gini.format(w='w - wr', w1='w1 - wr1')}"
    weighted = f"""SELECT '' AS path, x, y, n, n * CASE y WHEN 1 THEN total / (2 * ones) ELSE total / (2 * (total - ones)) END AS wt FROM (
        SELECT x, y, n, CAST(sum(n) OVER () AS DOUBLE) AS total, CAST(sum(n * y) OVER () AS DOUBLE) AS ones FROM (
            SELECT [{", ".join(FEATURES)}] AS x, {OUTCOME} AS y, count(*) AS n FROM frame GROUP BY ALL))"""
    steps, nodes = {"level0": weighted}, []
    for d in range(depth + 1):
        steps[f"best{d}"] = f"""SELECT path, f, w, w1, gain FROM (
            SELECT *, {gain} AS gain, row_number() OVER (PARTITION BY path ORDER BY round(({gain}) / w, 12) DESC, f) AS rank FROM (
                SELECT path, f, sum(wt) AS w, sum(wt * y) AS w1, sum(wt * x[f]) AS wr, sum(wt * x[f] * y) AS wr1, sum(n) AS size, sum(n * x[f]) AS size_r
                FROM level{d}, (SELECT unnest(range(1, {len(FEATURES) + 1})) AS f) GROUP BY path, f)
            WHERE {d} < {depth} AND w1 > 0 AND w1 < w AND size_r >= {min_leaf} AND size - size_r >= {min_leaf}) WHERE rank = 1"""
        steps[f"level{d + 1}"] = f"SELECT path || CAST(x[f] AS VARCHAR) AS path, x, y, n, wt FROM level{d} JOIN best{d} USING (path)"
        nodes.append(f"SELECT path, f, gain, weight, p FROM (SELECT path, sum(wt) AS weight, sum(wt * y) / sum(wt) AS p FROM level{d} GROUP BY path) LEFT JOIN best{d} USING (path)")
    return steps | {"tree": " UNION ALL ".join(nodes)}


@query(
    "unbagged_tree_splits",
    cleaned_sql(
        f"SELECT path, ({FEATURES!r})[f] AS feature, round(coalesce(gain, 0), 6) AS gain, round(weight, 6) AS weight, round(p, 9) AS p FROM tree",
        **FRAME,
        **tree_sql(3, 10),
    ),
)
def unbagged_tree_splits(spark, sf_dir):
    """The first three levels of a tree that draws neither records nor features."""
    sets = forest.training_sets(learn.folded_counts(_frame(spark, sf_dir), FEATURES, OUTCOME), FEATURES, OUTCOME, [None])
    nodes = forest.grow_forests(sets, len(FEATURES), 1, [10], 0, max_depth=3, bagged=False, tries=len(FEATURES))
    names = F.array(*[F.lit(f) for f in FEATURES])
    return nodes.select("path", F.when(F.col("feature") >= 0, F.get(names, F.col("feature"))).alias("feature"), F.round("gain", 6).alias("gain"), F.round("weight", 6).alias("weight"), F.round("p", 9).alias("p"))


@query("forest_threshold")
def forest_threshold(spark, sf_dir):
    """Where a forest's cut comes from: per fold the one that finds 95 % of the cases on the other folds."""
    return forest.cv_forest_threshold(_frame(spark, sf_dir), FEATURES, OUTCOME, KEY, 0.95)


# Forests draw samples, which SQL cannot repeat: rows only, numbers are checked in the tests.


@query("forest_importances")
def forest_importances(spark, sf_dir):
    return learn.importances(learn.fit_forest(_frame(spark, sf_dir), FEATURES, OUTCOME), FEATURES)


@query("forest_predictions")
def forest_predictions(spark, sf_dir):
    frame = _frame(spark, sf_dir)
    model = learn.fit_forest(frame, FEATURES, OUTCOME)
    scored = learn.score(model, frame.select(KEY, *FEATURES), FEATURES, "probability_of_outcome")
    predicted = predict_at(scored, "probability_of_outcome", study.FOREST_THRESHOLD, "prediction")
    return predicted.select(KEY, "probability_of_outcome", "prediction")


@query("forest_leaf_size_sweep")
def forest_leaf_size_sweep(spark, sf_dir):
    """Forests as large as the final one."""
    return learn.cv_forest(_frame(spark, sf_dir), FEATURES, OUTCOME, KEY, [1, 2, 5, 10, 20, 30, 50])


@query("model_stability")
def model_stability(spark, sf_dir):
    """Metrics of the three classifiers on the population cut at 14 and at 13."""
    return stability_report(cleaned(spark, sf_dir), [14, 13])
