"""Balanced random forest on weighted patterns of 0/1 features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.numbers import ratio
from wardbook.functions.predicates import name
from wardbook.operators.evaluate import threshold_per_fold
from wardbook.operators.logistic import COUNT, FOLD, folded_counts
from wardbook.session import settle

NODES = "held_out int, min_leaf int, tree int, node int, feature int, low int, high int, p double, weight double, gain double, path string"


@dataclass(frozen=True)
class ForestFit:
    """All nodes of a forest: a few hundred per tree at most, as flags have few combinations."""

    nodes: pd.DataFrame
    trees: int

    def values(self, bits: np.ndarray) -> np.ndarray:
        """Mean over the trees of the share of outcome 1 in the leaf of each pattern."""
        total = np.zeros(len(bits))
        for _, tree in self.nodes.groupby("tree"):
            total += leaf_values(tree.sort_values("node"), bits)
        return total / self.trees


def leaf_values(tree: pd.DataFrame, bits: np.ndarray) -> np.ndarray:
    feature, low, high, p = (tree[c].to_numpy() for c in ("feature", "low", "high", "p"))
    at = np.zeros(len(bits), np.int64)
    while (inner := feature[at] >= 0).any():
        one = (bits >> np.maximum(feature[at], 0)) & 1
        at = np.where(inner, np.where(one == 1, high[at], low[at]), at)
    return p[at]


def bits_of(features: Sequence[str]) -> str:
    """The flags as the bits of one whole number, as SQL text; a flag that is not 1 counts as 0."""
    return "(" + " + ".join(f"CASE WHEN {name(f)} = 1 THEN {1 << i}L ELSE 0L END" for i, f in enumerate(features)) + ")"


def gini(ones: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight times impurity."""
    return 2 * ones * (weight - ones) / np.where(weight > 0, weight, 1)


def grow(bits: np.ndarray, y: np.ndarray, records: np.ndarray, n_features: int, min_leaf: int, max_depth: int | None, tries: int, seed: list[int]) -> pd.DataFrame:
    """One tree on patterns with so many records each; both classes weigh the same in total.

    A node looks at ``tries`` features in random order, and at more until one
    gives two leaves of ``min_leaf`` records; the largest Gini gain wins, the
    first feature of ties. Nodes are numbered in the order they are made;
    ``path`` has the values of the flags asked on the way to them.
    """
    random = np.random.default_rng(seed)
    x = (bits[:, None] >> np.arange(n_features)) & 1
    n, ones = records.sum(), records[y == 1].sum()
    weight = records * np.where(y == 1, n / (2 * max(ones, 1)), n / (2 * max(n - ones, 1)))
    nodes, open_ = [], [(0, np.arange(len(bits)), "")]
    made = 1
    while open_:
        number, rows, path = open_.pop()
        w, w1 = weight[rows].sum(), weight[rows][y[rows] == 1].sum()
        node = [number, -1, -1, -1, w1 / w if w else 0.0, w, 0.0, path]
        nodes.append(node)
        if len(path) == max_depth or w1 <= 0 or w1 >= w:
            continue
        part = x[rows]
        size, right = records[rows].sum(), records[rows] @ part
        valid = (right >= min_leaf) & (size - right >= min_leaf) & (right > 0) & (right < size)
        if not valid.any():
            continue
        order = random.permutation(n_features)
        seen = max(tries, int(np.flatnonzero(valid[order])[0]) + 1)
        wr, wr1 = weight[rows] @ part, (weight[rows] * y[rows]) @ part
        gain = gini(w1, w) - gini(wr1, wr) - gini(w1 - wr1, w - wr)
        chosen = np.sort(order[:seen])
        chosen = chosen[valid[chosen]]
        # Rounded, so that equal gains are equal whatever the order of additions.
        best = int(chosen[np.argmax(np.round(gain[chosen] / w, 12))])
        node[1:4], node[6] = [best, made, made + 1], float(gain[best])
        open_ += [(made, rows[part[:, best] == 0], path + "0"), (made + 1, rows[part[:, best] == 1], path + "1")]
        made += 2
    return pd.DataFrame(sorted(nodes), columns=["node", "feature", "low", "high", "p", "weight", "gain", "path"])


def training_sets(counts: DataFrame, features: Sequence[str], y: str, folds: Sequence[int | None]) -> DataFrame:
    """(held_out, bits, y, n): per held-out fold the records of all other folds; -1 holds out none."""
    listed = ", ".join(str(-1 if f is None else f) for f in folds)
    rows = counts.selectExpr(f"explode(array({listed})) AS held_out", f"{bits_of(features)} AS bits", f"CAST({name(y)} AS INT) AS y", COUNT, FOLD)
    return settle(rows.where(f"held_out <> {FOLD}").groupBy("held_out", "bits", "y").agg(F.sum(COUNT).alias("n")), "training-patterns")


def grow_forests(sets: DataFrame, n_features: int, trees: int, leaf_sizes: Sequence[int], seed: int, max_depth: int | None = None, bagged: bool = True, tries: int | None = None) -> DataFrame:
    """The nodes of a forest per held-out fold and leaf size.

    A record drawn with replacement appears about Poisson(1) times, so n equal
    records do so Poisson(n) times: each tree's count of a pattern is drawn
    from that, by a generator seeded by tree set, pattern and outcome. So the
    draws depend on neither partitions nor row order, and their cost not on the
    number of records. One task grows a tree from its patterns.
    """
    tries = tries or max(1, int(np.sqrt(n_features)))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                drawn = np.random.default_rng([seed, r.held_out + 1, r.bits, r.y]).poisson(r.n, trees) if bagged else np.full(trees, r.n)
                tree = np.flatnonzero(drawn)
                yield pd.DataFrame({"held_out": r.held_out, "tree": tree, "bits": r.bits, "y": r.y, "records": drawn[tree]})

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bits", "y"])
        held_out, tree = int(frame["held_out"].iloc[0]), int(frame["tree"].iloc[0])
        columns = [frame[c].to_numpy() for c in ("bits", "y", "records")]
        made = [grow(*columns, n_features, m, max_depth, tries, [seed, held_out + 1, tree]).assign(min_leaf=m) for m in leaf_sizes]
        return pd.concat(made).assign(held_out=held_out, tree=tree)[[c.split()[0] for c in NODES.split(", ")]]

    bags = sets.mapInPandas(draw, "held_out int, tree int, bits bigint, y int, records bigint")
    return bags.groupBy("held_out", "tree").applyInPandas(grown, NODES)


def fit_forest(df: DataFrame, features: Sequence[str], y: str, trees: int = 200, min_leaf: int = 10, seed: int = 214, max_depth: int | None = None, count: str | None = None) -> ForestFit:
    """Balanced random forest; leaves hold at least ``min_leaf`` drawn records. Rows without an outcome are left out.

    Both outcomes are needed. After one aggregate the cost depends on the
    patterns, not on the rows. The nodes are collected.
    """
    sets = training_sets(folded_counts(df, features, y, count=count), features, y, [None])
    if sets.select("y").distinct().count() < 2:
        raise ValueError("both classes are needed to fit a model")
    nodes = grow_forests(sets, len(features), trees, [min_leaf], seed, max_depth)
    return ForestFit(nodes.toPandas().sort_values(["tree", "node"], ignore_index=True), trees)


def score_forest(model: ForestFit, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Add the forest's probability of outcome 1, computed once per pattern and joined back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"__bits": frame["__bits"], "__p": model.values(frame["__bits"].to_numpy())})

    keyed = df.withColumn("__bits", F.expr(bits_of(features)))
    points = settle(keyed.select("__bits").distinct().mapInPandas(run, "__bits bigint, __p double"), "pattern-scores")
    return keyed.join(points, "__bits").select(*df.columns, F.col("__p").alias(out))


def forest_importances(model: ForestFit, features: Sequence[str]) -> list[tuple[str, float]]:
    """Mean over the trees of each feature's share of the gains, in the order of ``features``."""
    gains = model.nodes[model.nodes["feature"] >= 0].pivot_table(index="tree", columns="feature", values="gain", aggfunc="sum", fill_value=0.0)
    shares = gains.div(gains.sum(axis=1), axis=0).mean() if len(gains) else pd.Series(dtype=float)
    return [(f, float(shares.get(i, 0.0))) for i, f in enumerate(features)]


def _fold_scores(df: DataFrame, features: Sequence[str], y: str, key: str, leaf_sizes: Sequence[int], k: int, trees: int, seed: int, max_depth: int | None) -> DataFrame:
    """(held_out, min_leaf, fold, score, pos, neg) of forests that have not seen the held-out fold, on all folds."""
    counts = folded_counts(df, features, y, key, k)
    points = counts.selectExpr(f"{bits_of(features)} AS bits", f"{FOLD} AS fold", f"CASE WHEN {name(y)} = 1 THEN {COUNT} ELSE 0 END AS pos", f"CASE WHEN {name(y)} = 0 THEN {COUNT} ELSE 0 END AS neg")
    points = settle(points.groupBy("bits", "fold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "points")
    seen = np.sort(points.select("bits").distinct().toPandas()["bits"].to_numpy())  # at most 2^features

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tree", "node"])
        p = ForestFit(frame, trees).values(seen)
        return pd.DataFrame({"held_out": int(frame["held_out"].iloc[0]), "min_leaf": int(frame["min_leaf"].iloc[0]), "bits": seen, "score": np.round(p, 9)})

    nodes = grow_forests(training_sets(counts, features, y, list(range(k))), len(features), trees, leaf_sizes, seed, max_depth)
    scores = nodes.groupBy("held_out", "min_leaf").applyInPandas(run, "held_out int, min_leaf int, bits bigint, score double")
    return settle(scores.join(points, "bits").groupBy("held_out", "min_leaf", "fold", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "fold-scores")


def cv_forest(df: DataFrame, features: Sequence[str], y: str, key: str, leaf_sizes: Sequence[int], k: int = 5, trees: int = 200, seed: int = 214, max_depth: int | None = None) -> DataFrame:
    """Cross-validated sensitivity and specificity at cut 0.5 for each minimum leaf size; weights are those of each training set."""
    held = _fold_scores(df, features, y, key, leaf_sizes, k, trees, seed, max_depth).where("fold = held_out")
    cells = {"tp": "score >= 0.5D THEN pos", "fn": "score < 0.5D THEN pos", "tn": "score < 0.5D THEN neg", "fp": "score >= 0.5D THEN neg"}
    folds = held.groupBy("min_leaf", "fold").agg(*[F.expr(f"sum(CASE WHEN {e} ELSE 0 END) AS {cell}") for cell, e in cells.items()])
    means = folds.groupBy("min_leaf").agg(F.expr(f"avg({ratio('tp', '(tp + fn)')}) AS mean_sensitivity"), F.expr(f"avg({ratio('tn', '(tn + fp)')}) AS mean_specificity"))
    return means.selectExpr("'min_leaf' AS parameter", "CAST(min_leaf AS DOUBLE) AS value", "mean_sensitivity", "mean_specificity")


def cv_forest_threshold(df: DataFrame, features: Sequence[str], y: str, key: str, target: float, min_leaf: int = 10, k: int = 5, trees: int = 200, seed: int = 214, max_depth: int | None = None) -> DataFrame:
    """Per fold: a forest grown on the other folds, the cut that reaches the target sensitivity there, its metrics on the fold."""
    scored = _fold_scores(df, features, y, key, [min_leaf], k, trees, seed, max_depth).drop("min_leaf")
    training = scored.where("fold <> held_out").groupBy("held_out", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return threshold_per_fold(training, scored.where("fold = held_out").drop("held_out"), target)
