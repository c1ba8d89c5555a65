"""Hand-computed goldens from the reference's unit-test arrays, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from arbiter.operators import confidence as U
from arbiter.operators import cost, evaluate, threshold


def test_classification_metrics_golden(spark):
    y = [0, 1, 1, 0, 1]
    pred = [0, 1, 0, 0, 1]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, pred))], "id long, y int, pred int")
    r = evaluate.classification_metrics(df, by=[]).first()
    assert r["accuracy"] == pytest.approx(0.8)
    assert r["precision"] == pytest.approx(13 / 15)
    assert r["recall"] == pytest.approx(0.8)
    assert r["f1"] == pytest.approx(0.8)
    cm = {(c["actual"], c["predicted"]): c["count"] for c in evaluate.confusion(df, by=[]).collect()}
    assert cm == {(0, 0): 2, (1, 0): 1, (1, 1): 2}


def test_regression_metrics_golden(spark):
    y = [1.0, 2.0, 3.0, 4.0, 5.0]
    p = [1.1, 2.1, 2.9, 4.1, 4.9]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, p))], "id long, y double, pred double")
    r = evaluate.regression_metrics(df, by=[]).first()
    assert r["mae"] == pytest.approx(0.1)
    assert r["rmse"] == pytest.approx(0.1)
    assert r["r2"] == pytest.approx(0.995)
    assert r["mape"] == pytest.approx((0.1 / 1 + 0.1 / 2 + 0.1 / 3 + 0.1 / 4 + 0.1 / 5) / 5)


def _scored(spark, n=400):
    rows = []
    for i in range(n):
        p = ((i * 7919) % 1000) / 1000.0
        y = 1 if ((i * 104729) % 1000) / 1000.0 < p else 0
        rows.append((i, "m", y, p))
    return spark.createDataFrame(rows, "id long, model string, y int, p double"), rows


def test_sweep_equals_brute_force(spark):
    df, rows = _scored(spark)
    got = {r["threshold"]: r for r in threshold.analyze_thresholds(df).collect()}
    assert len(got) == 101
    for i in range(101):
        t = i * 0.01
        tp = sum(1 for _, _, y, p in rows if p >= t and y == 1)
        fp = sum(1 for _, _, y, p in rows if p >= t and y == 0)
        r = got[round(t, 2)]
        assert (r["tp"], r["fp"]) == (tp, fp)
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == len(rows)


def test_auc_equals_pairwise(spark):
    df, rows = _scored(spark, 300)
    pos = [p for _, _, y, p in rows if y == 1]
    neg = [p for _, _, y, p in rows if y == 0]
    expect = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    got = threshold.roc_auc(df).first()["roc_auc"]
    assert got == pytest.approx(expect)


def test_roc_curve_ends_and_auc(spark):
    df, rows = _scored(spark, 300)
    pts = sorted((r["fpr"], r["tpr"]) for r in threshold.roc_curve(df).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(threshold.roc_auc(df).first()["roc_auc"])


def test_cost_optimal_threshold_first_min(spark):
    df, _ = _scored(spark)
    curve = cost.threshold_vs_cost(df).collect()
    best = min(curve, key=lambda r: (r["total_cost"], r["threshold"]))
    got = cost.optimal_threshold(df).first()
    assert got["threshold"] == best["threshold"] and got["total_cost"] == best["total_cost"]


def test_cost_zero_is_not_default(spark):
    df, _ = _scored(spark)
    d = df.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    r = cost.expected_cost(d, fp_cost=0.0).first()
    assert r["fp_cost"] == 0.0 and r["total_fp_cost"] == 0.0


def test_confidence_measures(spark):
    df = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [1 / 3, 1 / 3, 1 / 3])], "id long, prob array<double>")
    r = {x["prediction_id"]: x for x in U.reliability(df).collect()}
    assert r[0]["probability_confidence"] == pytest.approx(0.7)
    assert r[0]["margin_confidence"] == pytest.approx((0.7 - 0.2 + 1) / 2)
    ent = -sum(p * math.log(p + 1e-10) for p in [0.7, 0.2, 0.1]) / math.log(3)
    assert r[0]["uncertainty"] == pytest.approx(ent)
    assert r[1]["uncertainty"] == pytest.approx(1.0, abs=1e-6)
    assert r[0]["confidence_level"] == "Medium" and r[1]["confidence_level"] == "Low"


def test_cost_sensitivity_grid(spark):
    df, _ = _scored(spark)
    d = df.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    rows = cost.cost_sensitivity(d).collect()
    grid = sorted({(r["fp_cost"], r["fn_cost"]) for r in rows})
    vals = [10.0, 257.5, 505.0, 752.5, 1000.0]
    assert grid == [(a, b) for a in vals for b in vals]
    for r in rows:
        assert r["total_cost"] == pytest.approx(r["false_positives"] * r["fp_cost"] + r["false_negatives"] * r["fn_cost"])


def test_compare_thresholds_agrees_with_sweep(spark):
    df, _ = _scored(spark)
    sweep = {r["threshold"]: r for r in threshold.analyze_thresholds(df).collect()}
    comp = {r["threshold"]: r for r in threshold.compare_thresholds(df, [0.3, 0.5]).collect()}
    for t in (0.3, 0.5):
        assert (comp[t]["tp"], comp[t]["fp"], comp[t]["tn"], comp[t]["fn"]) == \
            (sweep[t]["tp"], sweep[t]["fp"], sweep[t]["tn"], sweep[t]["fn"])
        assert round(comp[t]["f1"], 4) == sweep[t]["f1"]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert "threshold" in df.columns and df.count() == 2


def test_ensemble_agreement(spark):
    rows = [(0, "a", 1), (0, "b", 1), (0, "c", 0), (1, "a", 0), (1, "b", 0), (1, "c", 0)]
    df = spark.createDataFrame(rows, "id long, model string, pred int")
    got = {r["prediction_id"]: r["agreement"] for r in U.ensemble_agreement(df).collect()}
    assert got[0] == pytest.approx(2 / 3) and got[1] == 1.0
    one = spark.createDataFrame([(0, "a", 1)], "id long, model string, pred int")
    assert U.ensemble_agreement(one).first()["agreement"] == 1.0


def test_confusion_wide_pivot(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 1)], "id long, y int, pred int")
    w = {r["actual"]: (r["0"], r["1"]) for r in evaluate.confusion_wide(df, by=[]).collect()}
    assert w == {0: (2, 0), 1: (1, 2)}


def test_cost_benefit_and_model_ranking(spark):
    rows = [(i, m, y, pr) for i, (m, y, pr) in enumerate(
        [("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("b", 1, 1), ("b", 0, 0), ("b", 1, 1)])]
    df = spark.createDataFrame(rows, "id long, model string, y int, pred int")
    b = {r["model"]: r for r in cost.cost_benefit(df).collect()}
    # a: tp 1, fp 1, fn 1 -> cost 600, benefit 1000, net 400, roi 66.67 %
    assert b["a"]["total_cost"] == 600.0 and b["a"]["net_benefit"] == 400.0
    assert b["a"]["roi"] == pytest.approx(400 / 600 * 100)
    # b: no errors -> zero cost, ROI 0 by definition
    assert b["b"]["total_cost"] == 0.0 and b["b"]["roi"] == 0.0
    ranks = {r["model"]: r["cost_rank"] for r in cost.compare_model_costs(df).collect()}
    assert ranks == {"b": 1, "a": 2}
