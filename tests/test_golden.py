"""Edge rows traced by hand."""

from __future__ import annotations

import pytest

from wardbook.functions import binning
from wardbook.functions.numbers import wilson_lower, wilson_upper
from wardbook.operators import cleaning, rules
from wardbook.operators.decision import apply_rule, rule_reason
from wardbook.operators.evaluate import threshold_for_sensitivity
from wardbook.operators.identifiers import fill_id_gaps
from wardbook.operators.project import derive_flags, flag_at_least, null_codes
from wardbook.operators.repair import repair, repair_dependents, repair_implies
from wardbook.operators.risk import risk_ratio
from wardbook.operators.validate import validate, violations
from wardbook.plans import head_trauma as study

E, V, M, T = *study.GCS_PARTS, study.GCS_TOTAL

# Name, eye, verbal, motor, total going in; the same coming out; category and flag.
SCORES = [
    ("clean", (4, 5, 6, 15), (4, 5, 6, 15), 2, 1),
    ("one part missing", (None, 5, 6, 15), (4, 5, 6, 15), 2, 1),
    ("two parts missing", (None, None, 6, 15), (None, None, 6, 15), 2, 1),
    ("total too low", (4, 5, 6, 14), (4, 5, 6, 15), 2, 1),
    ("eye 5", (5, 5, 6, 16), (4, 5, 6, 15), 2, 1),
    ("eye 5, total right by chance", (5, 5, 6, 15), (4, 5, 6, 15), 2, 1),
    ("verbal 0", (4, 0, 6, 10), (4, 1, 6, 11), 1, 0),
    ("verbal 6", (4, 6, 5, 15), (4, 5, 5, 14), 2, 1),
    ("imputed, then verbal 6", (None, 6, 6, 15), (3, 5, 6, 14), 2, 1),
    ("imputed, then verbal 0", (4, 0, None, 9), (4, 1, 5, 10), 1, 0),
    ("category not derived again", (5, 4, 5, 14), (4, 4, 5, 13), 2, 0),
    ("missing total filled", (4, 5, 6, None), (4, 5, 6, 15), 2, 1),
    ("nothing to go by", (None, 5, 6, None), (None, 5, 6, None), 1, 0),
]


def test_scores_through_the_cleaning_order(rows):
    df = rows(f"rid {E} {V} {M} {T} gcs_category", [(i, *given, 1) for i, (_, given, *_) in enumerate(SCORES)])
    df = cleaning.impute_from_total(df, study.GCS_PARTS, T)
    df = cleaning.rederive_total(df, study.GCS_PARTS, T)
    df = cleaning.rederive_category(df, T, study.GCS_CATEGORIES, "gcs_category")
    df = cleaning.snap_codes(df, study.GCS_SNAPS, T)
    df = flag_at_least(df, T, 14, "flag")
    got = {r["rid"]: (tuple(r[c] for c in (E, V, M, T)), r["gcs_category"], r["flag"]) for r in df.collect()}
    for i, (label, _, expected, category, flag) in enumerate(SCORES):
        assert got[i] == (expected, category, flag), label


def test_corrections_keep_column_types(rows):
    df = rows(f"rid {E} {V} {M} {T}", [(1, 5, None, 6, 15)])
    before = df.schema
    df = cleaning.impute_from_total(df, study.GCS_PARTS, T)
    df = cleaning.rederive_total(df, study.GCS_PARTS, T)
    assert [f.dataType for f in cleaning.snap_codes(df, study.GCS_SNAPS, T).schema] == [f.dataType for f in before]


def test_flag_promotion(rows):
    cases = [  # flag, finding a, finding b, depressed, expected
        (0, 1, None, 1, 1),
        (None, None, 1, 1, 1),
        (0, 1, None, 0, 0),
        (0, 1, None, None, 0),
        (0, 0, 0, 1, 0),
        (1, 0, 0, 0, 1),
        (None, 0, 0, 1, None),
    ]
    df = rows("rid flag a b depressed", [(i, *c[:4]) for i, c in enumerate(cases)])
    got = cleaning.promote_flag(df, "flag", ["a", "b"], "depressed").orderBy("rid").collect()
    assert [r["flag"] for r in got] == [c[4] for c in cases]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize(
    ("ids", "expected"),
    [
        ([1, None, 3, None, 6], [1, 2, 3, 4, 6]),
        ([1, None, 3, None], [1, 2, 3, None]),
        ([1, 2, 2, 5, None], [1, 2, 2, 5, 3]),
        ([1, 2, 3], [1, 2, 3]),
        ([None, None], [None, None]),
        ([7, None, 10_000_000_000], [7, 8, 10_000_000_000]),
    ],
)
def test_id_gaps(spark, broadcast, ids, expected):
    """Recovered ids broadcast or shuffled to the rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = spark.createDataFrame(list(enumerate(ids)), "rid bigint, pid bigint")
        got = fill_id_gaps(df, "pid", "rid").orderBy("rid").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r["pid"] for r in got] == expected


def test_id_gaps_need_a_unique_order(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1), (3, 4)], "rid bigint, pid bigint")
    with pytest.raises(ValueError):
        fill_id_gaps(df, "pid", "rid")


def test_newborn_months(rows):
    df = rows("rid years months", [(0, 0, None), (1, 1, None), (2, 0, 5), (3, None, None)])
    got = cleaning.fill_when(df, "months", "years = 0", 0).orderBy("rid").collect()
    assert [r["months"] for r in got] == [0, None, 5, None]


def test_sentinel_in_every_column_or_all_but_some(rows):
    df = rows("rid months code", [(92, 92, 92), (1, 92, 3), (2, None, 92)])
    everywhere = null_codes(df).collect()
    assert [tuple(r) for r in everywhere] == [(None, None, None), (1, None, 3), (2, None, None)]
    spared = null_codes(df, exclude=["rid", "months"]).collect()
    assert [tuple(r) for r in spared] == [(92, 92, None), (1, 92, 3), (2, None, None)]


def test_detail_without_parent(rows):
    parents = {"parent": ["a", "b"]}
    df = rows("rid parent a b", [(0, 0, 0, None), (1, None, 1, 2), (2, 1, 1, 2), (3, 0, None, None)])
    found = {r["rule"]: r["n_violations"] for r in validate(df, rules.dependents(parents)).collect()}
    assert found["parent absent"] == 1
    strict = {r["rule"]: r["n_violations"] for r in validate(df, rules.dependents(parents, zero_is_value=True)).collect()}
    assert strict["parent absent"] == 2
    fixed, counts = repair(df, [repair_dependents(parents)])
    assert {r["column"]: r["n_fixed"] for r in counts.collect()} == {"a": 1, "b": 1, None: 2}
    assert [tuple(r) for r in fixed.orderBy("rid").collect()] == [
        (0, 0, 0, None), (1, None, None, None), (2, 1, 1, 2), (3, 0, None, None)
    ]


def test_missing_requirement_violates(rows):
    df = rows("rid palpable depressed", [(0, None, 1), (1, 2, 1), (2, 1, 1), (3, None, None)])
    needs = rules.implies("depressed", "palpable")
    assert [r["rid"] for r in violations(df, [needs], "rid").orderBy("rid").collect()] == [0, 1]
    stages = [repair_dependents({"palpable": ["depressed"]}), repair_implies("depressed", "palpable", "set")]
    fixed, _ = repair(df, stages)
    assert [tuple(r) for r in fixed.orderBy("rid").collect()] == [
        (0, None, None), (1, 1, 1), (2, 1, 1), (3, None, None)
    ]


def test_age_bins_and_bands(rows):
    ages = [0, 1, 2, 3, 5, 6, 12, 13, 17, 18, None]
    df = rows("rid age", list(enumerate(ages)))
    got = df.selectExpr("rid", f"{binning.right_closed('age', study.AGE_EDGES, study.AGE_LABELS)} AS b").orderBy("rid")
    assert [r["b"] for r in got.collect()] == [
        "<1yr", "1-2yr", "1-2yr", "3-5yr", "3-5yr", "6-12yr", "6-12yr", "13-17yr", "13-17yr", None, None
    ]
    got = df.selectExpr("rid", f"{binning.left_closed('age', study.RISK_BANDS)} AS b").orderBy("rid")
    assert [r["b"] for r in got.collect()] == [
        "<2yr", "<2yr", "2-5yr", "2-5yr", "2-5yr", "6-12yr", "6-12yr", "13-17yr", "13-17yr", None, None
    ]


def test_wilson_bounds(rows):
    df = rows("rid k n", [(0, 0, 0), (1, 0, 10), (2, 10, 10), (3, 3, 10)])
    got = df.selectExpr("rid", f"{wilson_lower('k', 'n')} AS lo", f"{wilson_upper('k', 'n')} AS hi").orderBy("rid").collect()
    assert (got[0]["lo"], got[0]["hi"]) == (None, None)
    assert got[1]["lo"] == 0 and got[1]["hi"] == pytest.approx(100 * 1.96**2 / (10 + 1.96**2))
    assert got[2]["hi"] == 100 and got[2]["lo"] == pytest.approx(100 - got[1]["hi"])
    assert got[3]["lo"] < 30 < got[3]["hi"]


RULE_CASES = [  # age group, loss of consciousness, its duration, acting normal, category -> prediction, reason
    ((1, 1, 2, 1, 2), 1, "cdr_loc_over5s"),
    ((1, 1, 1, 1, 2), 0, None),
    ((2, 1, 1, 1, 2), 1, "cdr_loc_any"),
    ((2, 0, None, 0, 2), 0, None),
    ((1, 0, None, 1, 1), 1, "gcs_category"),
    ((None, 1, 4, 0, 1), None, None),
]


def test_decision_rule(rows):
    used = [
        "patient_age_under_2yr", "has_loss_of_consciousness_history", "loss_of_consciousness_duration",
        "acting_normal", "gcs_category",
    ]
    others = sorted({c for tests in study.PREDICTOR_FLAGS.values() for c, _ in tests} - set(used))
    df = rows(" ".join(["rid", *used, *others]), [(i, *c[0], *[None] * len(others)) for i, c in enumerate(RULE_CASES)])
    df = derive_flags(df, study.PREDICTOR_FLAGS)
    df = apply_rule(df, study.AGE_GROUP, study.RULE_BRANCHES, "p")
    df = rule_reason(df, study.AGE_GROUP, study.RULE_BRANCHES, "why")
    got = df.orderBy("rid").collect()
    assert [(r["p"], r["why"]) for r in got] == [(p, why) for _, p, why in RULE_CASES]


def test_highest_threshold_reaching_the_target(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 1)], "s double, y int")
    row = threshold_for_sensitivity(df, "s", "y", 0.6).first()
    assert (row["threshold"], row["tp"], row["fp"]) == (0.7, 2, 1)
    nobody = threshold_for_sensitivity(df.where("y = 0"), "s", "y", 0.6).first()
    assert nobody["threshold"] is None


def test_risk_ratio_that_cannot_be_formed_is_zero(rows):
    df = rows("age sign y", [(1, 1, 1), (1, 1, 0), (1, 0, 1), (1, 0, 0), (1, 0, 0), (1, 0, 0), (3, 1, 1), (7, 1, 1), (7, 0, 0)])
    got = {r["band"]: r for r in risk_ratio(df, {"sign": "sign"}, "age", study.RISK_BANDS, "y", digits=1).collect()}
    assert got["<2yr"]["risk_ratio"] == 2.0
    assert got["2-5yr"]["risk_ratio"] == 0 and got["2-5yr"]["n_neg"] == 0
    assert got["6-12yr"]["risk_ratio"] == 0 and got["6-12yr"]["n_neg"] == 1
    assert got["13-17yr"]["n_pos"] == 0
