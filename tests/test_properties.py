"""Invariants, and operators against brute force on skewed tables."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from catalog.base import KEY, clean_lazily, cleaned, nulled, raw
from wardbook.operators import duplicates, ranking
from wardbook.operators.evaluate import balanced_weight, cv_threshold, evaluate
from wardbook.operators.filters import top_k_values
from wardbook.operators.profile import box_stats, describe, histogram
from wardbook.operators.identifiers import fill_id_gaps
from wardbook.operators.ranking import quantiles, ranged, running_totals
from wardbook.operators.rates import dominant, rate_matrix, rate_table_ci, share_matrix
from wardbook.operators.project import label_codes
from wardbook.operators.repair import repair
from wardbook.operators.rules import rule
from wardbook.operators.validate import validate, validate_with_values, violations
from wardbook.plans import head_trauma as study
from wardbook.plans.cleaning import CleanConfig, clean, standard_repair, standard_rules
from wardbook.plans.findings import risk_by_mechanism
from wardbook.plans.modelling import model_frame, rule_metrics


def test_cleaning_keeps_every_visit_and_recovers_ids(spark, sf_dir):
    before = raw(spark, sf_dir)
    after = clean_lazily(spark, sf_dir, order_by=KEY)
    assert after.count() == before.count()
    assert after.where(f"patient_number <> {KEY} + 1 OR patient_number IS NULL").count() == 0


def test_repair_is_idempotent_and_leaves_no_relational_violation(spark, sf_dir):
    visits = nulled(spark, sf_dir)
    fixed, counts = repair(visits, standard_repair(visits))
    assert counts.where("step = 'total'").first()["n_fixed"] > 0
    again, second = repair(fixed, standard_repair(fixed))
    assert second.where("n_fixed > 0").count() == 0
    assert again.exceptAll(fixed).count() == 0
    left = validate(fixed, standard_rules(fixed)).where("`check` NOT IN ('codes', 'total')")
    assert left.where("n_violations > 0").count() == 0


def test_report_counts_equal_violating_cells(spark, sf_dir):
    visits = nulled(spark, sf_dir)
    checks = standard_rules(visits)
    total = validate(visits, checks).where("`check` = 'total'").first()["n_violations"]
    assert violations(visits, checks, KEY).count() == total > 0


def test_confusion_counts_add_up(spark, sf_dir):
    row = rule_metrics(model_frame(cleaned(spark, sf_dir))).first()
    assert row["tp"] + row["tn"] + row["fp"] + row["fn"] == row["n"]
    assert row["tp"] + row["fn"] == row["positives"]


def test_intervals_hold_the_rate(spark, sf_dir):
    for row in risk_by_mechanism(cleaned(spark, sf_dir)).collect():
        assert row["ci_lower"] <= row["rate"] <= row["ci_upper"]


def test_weights_balance_the_classes(spark, sf_dir):
    frame = balanced_weight(model_frame(cleaned(spark, sf_dir)), study.OUTCOME, "w")
    sums = [r["s"] for r in frame.groupBy(study.OUTCOME).agg({"w": "sum"}).toDF("y", "s").collect()]
    assert sums[0] == pytest.approx(sums[1])


def test_counts_on_patterns_equal_counts_on_rows(spark, sf_dir):
    frame = model_frame(cleaned(spark, sf_dir))
    plain = evaluate(frame, study.OUTCOME, "cdr_ams").first()
    grouped = frame.groupBy(study.OUTCOME, "cdr_ams").count()
    assert evaluate(grouped, study.OUTCOME, "cdr_ams", count="count").first() == plain


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, one group and one code."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        hot = rng.random() < 0.35
        value = 7.0 if hot else rng.choice([None, rng.lognormvariate(0, 3), float(rng.randrange(50))])
        data.append((i, "hot" if hot else rng.choice("abc"), 3 if hot else rng.choice([None, 1, 2, 4, 5]), value, int(rng.random() < 0.2)))
    return spark.createDataFrame(data, "rid bigint, g string, code int, x double, y int"), data


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, skewed, descending):
    df, data = skewed
    counts = df.where("x IS NOT NULL").groupBy("g", "x").count()
    got = {(r["g"], r["x"]): r["upto"] for r in running_totals(counts, "x", {"count": "upto"}, "g", descending).collect()}
    for (g, x), upto in got.items():
        expected = sum(
            1 for _, g2, _, x2, _ in data if g2 == g and x2 is not None and (x2 >= x if descending else x2 <= x)
        )
        assert upto == expected
    assert len(got) == len({(g, x) for _, g, _, x, _ in data if x is not None})


def test_quantiles_and_describe(spark, skewed):
    df, data = skewed
    xs = np.array([x for *_, x, _ in data if x is not None])
    row = quantiles(df, ["x"], {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).first()
    for name, share in zip("abcde", (0, 0.25, 0.5, 0.9, 1)):
        assert row[name] == pytest.approx(np.quantile(xs, share), rel=1e-12)
    row = describe(df, ["x"]).first()
    assert row["count"] == len(xs)
    assert row["std"] == pytest.approx(xs.std(ddof=1))
    rough = describe(df, ["x"], exact=False).first()
    assert rough["median"] == pytest.approx(np.quantile(xs, 0.5), rel=0.1)
    empty = describe(df.where("x < -1"), ["x"]).first()
    assert (empty["count"], empty["median"]) == (0, None)


def test_box_and_histogram(spark, skewed):
    df, data = skewed
    xs = np.array([x for *_, x, _ in data if x is not None])
    q1, q3 = np.quantile(xs, [0.25, 0.75])
    inside = xs[(xs >= q1 - 1.5 * (q3 - q1)) & (xs <= q3 + 1.5 * (q3 - q1))]
    row = box_stats(df, "x").first()
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (inside.min(), inside.max(), len(xs) - len(inside))
    bars = histogram(df, "x", 7).orderBy("bin").collect()
    assert [b["n"] for b in bars] == np.histogram(xs, 7)[0].tolist()
    constant = histogram(df.where("x = 7"), "x", 4).orderBy("bin").collect()
    assert [b["n"] for b in constant] == np.histogram([7.0] * (xs == 7).sum(), 4)[0].tolist()


def test_shares_matrix_and_dominant(spark, skewed):
    df, data = skewed
    got = {(r["g"], r["code"]): r for r in share_matrix(df, "g", "code", 3, ["hot", "a", "nobody"]).collect()}
    top = [r["code"] for r in top_k_values(df, "code", 3).collect()]
    assert len(got) == 9
    for (g, code), r in got.items():
        size = sum(1 for d in data if d[1] == g)
        hits = sum(1 for d in data if d[1] == g and d[2] == code)
        assert code in top and r["n"] == hits and r["share"] == pytest.approx(100 * hits / size if size else 0)
    matrix = rate_matrix(df, "code", "g", "y", ["hot", "a"], 5, min_n=200)
    for r in matrix.collect():
        cell = [d[4] for d in data if d[1] == r["g"] and d[2] == r["code"]]
        assert r["n"] == len(cell)
        assert r["rate"] == (pytest.approx(100 * sum(cell) / len(cell)) if len(cell) >= 200 else None)
    best = {r["g"]: r["code"] for r in dominant(df, "g", "code").collect()}
    for g, code in best.items():
        tally = {c: sum(1 for d in data if d[1] == g and d[2] == c) for c in range(1, 6)}
        assert tally[code] == max(tally.values()) and code == min(c for c, n in tally.items() if n == tally[code])


def test_rate_denominators(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (1, 0), (2, None), (None, 1)], "f int, y int")
    known = {r["f"]: r["rate"] for r in rate_table_ci(df, "f", "y", denom="known").collect()}
    every = {r["f"]: r["rate"] for r in rate_table_ci(df, "f", "y", denom="all").collect()}
    assert known == {1: 50.0, 2: 0.0}
    assert every == {1: pytest.approx(100 / 3), 2: 0.0}
    with pytest.raises(ValueError):
        rate_table_ci(df, "f", "y", denom="some")


def test_cross_validated_threshold(spark, skewed):
    df, data = skewed
    got = {r["fold"]: r for r in cv_threshold(df, "rid", "x", "y", 0.7, k=4).collect()}
    known = [(rid % 4, x, y) for rid, _, _, x, y in data if x is not None]
    assert set(got) == {0, 1, 2, 3}
    for fold, row in got.items():
        train = [(x, y) for f, x, y in known if f != fold]
        positives = sum(y for _, y in train)
        best = max(t for t in {x for x, _ in train} if sum(y for x, y in train if x >= t) / positives >= 0.7)
        test = [(x, y) for f, x, y in known if f == fold]
        assert row["threshold"] == best
        assert row["tp"] == sum(y for x, y in test if x >= best)
        assert row["fp"] == sum(1 - y for x, y in test if x >= best)
        assert row["n"] == len(test)


def test_duplicates_with_a_large_group_of_copies(spark):
    data = [(1, "same", None)] * 400 + [(i, f"t{i}", i) for i in range(2, 600)] + [(700, None, None)] * 2
    df = spark.createDataFrame(data, "rid bigint, t string, c int")
    row = duplicates.duplicate_summary(df, expected_rows=1000).first()
    assert (row["n_rows"], row["n_distinct"], row["n_duplicates"], row["as_expected"]) == (1000, 600, 400, True)
    assert duplicates.duplicate_rows(df).count() == 402
    assert duplicates.duplicate_rows(df, ["t"]).count() == 402
    none = duplicates.duplicate_summary(df.where("rid BETWEEN 2 AND 600")).first()
    assert none["n_duplicates"] == 0


def test_toxic_queries_take_all_lengths_sources_and_languages(spark, tmp_path):
    from catalog.base import QUERIES

    rows = [(i, f"s{i % 23}", ["en", "pt", "zh"][i % 3], 2_000_000) for i in range(690)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(690).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "CAST(id % 4 = 0 AS INT) AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    bands = {r["band"]: r for r in QUERIES["toxic_risk_by_quality"](spark, str(tmp_path)).collect()}
    assert bands["long"]["n_pos"] + bands["long"]["n_neg"] == 690
    cells = QUERIES["toxic_rate_by_source_and_language"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in cells) == 690 and len({r["source"] for r in cells}) == 23 and {"pt", "es"} <= {r["lang"] for r in cells}


def test_forests_are_never_cut_silently(spark, monkeypatch):
    """Trees over 31 flags grow until their leaves are pure, a depth given is kept, and the sweep grows 200 trees."""
    from catalog import model_queries
    from wardbook.operators import forest

    bits = np.array([(1 << i) - 1 for i in range(32)])
    args = bits, np.arange(32) % 2, np.full(32, 3), 31, 1
    whole, cut = (forest.grow(*args, depth, 31, [1]) for depth in (None, 3))
    leaves = whole[whole["feature"] < 0]
    assert len(leaves) == 32 and set(leaves["p"]) == {0.0, 1.0}
    assert cut["path"].str.len().max() == 3
    sizes = []

    def stop(sets, n_features, trees, *rest, **more):
        sizes.append(trees)
        raise InterruptedError

    monkeypatch.setattr(forest, "grow_forests", stop)
    monkeypatch.setattr(model_queries, "_frame", lambda *_: spark.range(40).selectExpr("id AS event_id", *[f"CAST(id % 2 AS INT) AS {c}" for c in {*model_queries.FEATURES, model_queries.OUTCOME}]))
    with pytest.raises(InterruptedError):
        model_queries.forest_leaf_size_sweep(spark, "")
    assert sizes == [200]


def test_ranges_are_even_despite_outliers_and_crowding(spark):
    """One value of 1e15 among two million distinct ones, and scores crowded near zero."""
    n = 2_000_000
    values = spark.range(n).selectExpr("CASE WHEN id = 0 THEN 1e15D ELSE CAST(id AS DOUBLE) END AS x", "1L AS one")
    crowded = spark.range(n).selectExpr("CASE WHEN id % 1000 = 0 THEN rand(3) ELSE rand(5) * 1e-9 END AS x", "1L AS one").groupBy("x").agg({"one": "sum"}).toDF("x", "one")
    for df in (values, crowded):
        sizes = [r["count"] for r in ranged(df, "x").groupBy("__range").count().collect()]
        assert len(sizes) > 4 and max(sizes) < 3 * sum(sizes) / len(sizes)
    row = quantiles(values, ["x"], {"median": 0.5, "top": 1.0}).first()
    assert (row["median"], row["top"]) == (n / 2 + 0.5, 1e15)


@pytest.mark.parametrize("start, step", [(-40_000, 1), (10**12, 1), (0, 3_000), (-5, 70_000)])
def test_gaps_of_far_and_sparse_ids(spark, start, step):
    """Ids from negative to very large ones, dense and sparse, against plain Python."""
    rng = random.Random(start)
    rows = [(i * 7 - 3_000, None if rng.random() < 0.2 else start + i * step) for i in range(2_000)]
    rows[0], rows[-1] = (rows[0][0], start), (rows[-1][0], start + 1_999 * step)
    rows += [(20_000 + i, start + step * 5) for i in range(300)]  # copies of one id
    used = {v for _, v in rows if v is not None}
    free = (v for v in range(min(used), max(used) + 1) if v not in used)
    expected = {key: next(free, None) for key, v in sorted(rows) if v is None}
    df = spark.createDataFrame(rows, "rid bigint, pid bigint").repartition(6)
    got = {r["rid"]: r["pid"] for r in fill_id_gaps(df, "pid", "rid").collect()}
    assert len(got) == len(rows)
    assert all(got[key] == (v if v is not None else expected[key]) for key, v in rows)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),), (None,)], "x double")
    assert [(r["lower"], r["n"]) for r in histogram(df, "x", 3).orderBy("bin").collect()] == [(1.0, 1), (2.0, 1), (3.0, 1)]
    box = box_stats(df, "x").first()
    assert (box["median"], box["whisker_high"], box["n_outliers"]) == (2.0, 4.0, 0)


def test_report_is_counted_by_the_write(spark, sf_dir, tmp_path):
    """The observed report equals one more pass over the saved table."""
    saved = clean(raw(spark, sf_dir), CleanConfig(keep_codes=(KEY,), order_by=KEY), save_to=str(tmp_path / "cleaned"))
    again = validate(saved.data, standard_rules(saved.data))
    assert sorted(map(tuple, saved.report.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert saved.data.where("patient_number IS NULL").count() == 0


def test_violations_keep_text_and_fractions(spark):
    df = spark.createDataFrame([(1, "bad", 2.5), (2, "ok", 0.5)], "rid bigint, t string, d double")
    text, fraction = rule("text", "t = 'bad'", "t"), rule("fraction", "d > 1", "d")
    assert [r["value"] for r in violations(df, [text], "rid").collect()] == ["bad"]
    assert [r["value"] for r in violations(df, [fraction], "rid").collect()] == [2.5]


def test_long_label_lists(spark):
    df = spark.createDataFrame([(5, 7), (6, None), (7, 99_999)], "rid bigint, code int")
    labels = {i: f"label {i}" for i in range(5_000)}
    got = {r["rid"]: r["out"] for r in label_codes(df, "code", labels, "out", "none").collect()}
    assert got == {5: "label 7", 6: "none", 7: "none"}


def _inputs_of_exchanges(df):
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) \w*Exchange\nInput \[\d+\]: \[(.*?)\]", plan)


def test_the_sieve_moves_no_rows(spark):
    """A third of the rows share one value; only hashes and the bit set are exchanged before the suspects are written."""
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, id) AS k", "concat('wide', id) AS wide", "id AS other")
    passed, n_rows = duplicates._sieve(df, ["k"])
    assert n_rows == 3000
    moved = ", ".join(_inputs_of_exchanges(passed) + _inputs_of_exchanges(duplicates._hash_counts(df, ["k"])))
    assert "__row_hash" in moved and not re.search(r"\b(k|wide|other)#", moved)
    assert 1000 <= passed.count() < 1400
    rows = duplicates.duplicate_rows(df, ["k"])
    assert rows.columns == df.columns and rows.count() == 1000 and rows.where("k <> -1").count() == 0
    assert tuple(duplicates.duplicate_summary(df, ["k"]).first()) == (3000, 2001, 999)


def test_a_full_bit_set_changes_the_cost_only(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "FILTER_BITS", 64)
    df = spark.range(2000).selectExpr("id % 1500 AS k", "CAST(NULL AS INT) AS empty")
    assert duplicates.duplicate_rows(df).count() == 1000
    assert tuple(duplicates.duplicate_summary(df).first()) == (2000, 1500, 500)
    assert tuple(duplicates.duplicate_summary(df.where("k < 0")).first()) == (0, 0, 0)


def test_report_with_values_reads_once(spark):
    rows_ = [rule("a in list", "a > 1", "a"), rule("b in list", "b < 0", "b"), rule("never", "b = 99", "b")]
    df = spark.range(3000).selectExpr("CAST(IF(id % 3 = 0, 7, IF(id = 1, 8, 1)) AS INT) AS a", "IF(id = 5, -1.5D, 0D) AS b")
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    report, values = validate_with_values(df.mapInPandas(counted, df.schema), rows_)
    assert {(r["rule"], r["n_violations"]) for r in report.collect()} == {("a in list", 1001), ("b in list", 1), ("never", 0), ("all rules", 1002)}
    assert {(r["rule"], r["value"], r["n"]) for r in values.collect()} == {("a in list", 7.0, 1000), ("a in list", 8.0, 1), ("b in list", -1.5, 1)}
    assert reads.value == 3000
    none = validate_with_values(df.where("a = 1 AND b = 0"), rows_)
    assert none[0].where("n_violations <> 0").count() == 0 and none[1].count() == 0


def test_sketches_of_halves_merge_into_that_of_the_whole(spark):
    df = spark.range(200_000).selectExpr("IF(id % 3 = 0, 0D, IF(id = 1, 1e15D, IF(id = 2, double('NaN'), id * 1D))) AS x", "id % 2 AS half", "CAST(NULL AS DOUBLE) AS none")
    shares = {f"q{i}": i / 20 for i in range(1, 20)}
    parts = ranking.quantile_sketches(df, ["x", "none"], by=["half"])
    merged = ranking.sketch_quantiles(ranking.merge_sketches(parts), shares).collect()
    whole = ranking.quantiles(df, ["x", "none"], shares, exact=False).collect()
    assert [r["column"] for r in merged] == [r["column"] for r in whole] == ["x"]
    known = df.where("NOT isnan(x)")
    n = known.count()
    for found in (merged[0], whole[0]):
        for q, share in shares.items():
            below, upto = known.selectExpr(f"count_if(x < {found[q]!r}D)", f"count_if(x <= {found[q]!r}D)").first()
            assert below / n <= share + 0.002 and upto / n >= share - 0.002


def test_populations_read_the_table_once(spark, sf_dir):
    """Any list of thresholds takes one pass, and gives what each threshold by itself gives."""
    from wardbook.operators.project import flag_at_least
    from wardbook.plans.findings import SIGNS, risk_by_sign, sign_stability
    from wardbook.plans.modelling import rule_stability

    visits = cleaned(spark, sf_dir)
    expected = {}
    for t in (15, 14, 13, 3):
        expected[t] = tuple(rule_metrics(model_frame(flag_at_least(visits, study.GCS_TOTAL, t, study.PRIMARY_FLAG))).first())
    sizes = {t: risk_by_sign(flag_at_least(visits, study.GCS_TOTAL, t, study.PRIMARY_FLAG)).collect() for t in (14, 13)}
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    columns = dict.fromkeys(["patient_age_years", *SIGNS.values(), *[c for c in visits.columns if c not in SIGNS.values()]])
    once = visits.select(*columns).mapInPandas(counted, visits.select(*columns).schema)
    got = {r["threshold"]: tuple(r[c] for c in r.asDict() if c != "threshold") for r in rule_stability(once, [15, 14, 13, 3, 16]).collect()}
    assert got == expected and reads.value == visits.count()
    reads_before = reads.value
    stable = {(r["band"], r["sign"]): (r["before"], r["after"]) for r in sign_stability(once).collect()}
    assert reads.value == 2 * reads_before
    for i, t in enumerate((14, 13)):
        assert {(r["band"], r["sign"]): r["risk_ratio"] for r in sizes[t]} == {k: v[i] for k, v in stable.items()}
