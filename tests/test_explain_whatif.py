"""Additivity of attributions, counterfactual flips, what-if defaults."""

import math

import pytest
from pyspark.sql import functions as F

from arbiter.operators import counterfactual as K
from arbiter.operators import explain as X
from arbiter.operators import whatif as W
from arbiter.operators.common import attach
from arbiter.operators.scorer import LinearScorer

S = LinearScorer("s", {"a": 1.2, "b": -0.7, "c": 0.4}, intercept=0.1)


def _frame(spark, n=120, offset=0):
    rows = [(i + offset, math.sin(i) * 2, math.cos(i * 0.7), float(i % 3), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


def test_linear_shap_additive(spark):
    df, bg = _frame(spark, 40), _frame(spark, 200, 1000)
    phi = X.linear_shap(df, S, bg)
    per = phi.groupBy("id").agg(F.sum("phi").alias("s"), F.first("base_value").alias("b"), F.first("z").alias("z"))
    for r in per.collect():
        assert r["s"] + r["b"] == pytest.approx(r["z"])


def test_sampled_shapley_telescopes(spark):
    df, bg = _frame(spark, 30), _frame(spark, 50, 1000)
    k = 4
    phi = X.sampled_shapley(df, S, bg, samples=k)
    tot = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    fx = {r["id"]: r["p"] for r in df.select("id", S.p().alias("p")).collect()}
    # sum of contributions = f(x) - mean over samples of f(background row)
    bgp = [r["p"] for r in bg.select(S.p().alias("p")).collect()]
    for i, s in tot.items():
        assert fx[i] - s == pytest.approx(sum(bgp) / len(bgp), abs=0.5)  # a mean of sampled rows
        assert min(bgp) - 1e-9 <= fx[i] - s <= max(bgp) + 1e-9


def test_counterfactuals_flip(spark):
    tr, te = _frame(spark, 200), _frame(spark, 40, 5000)
    cf = K.find(te, tr, S, ["a", "b"], ["c"])
    rows = cf.collect()
    assert rows
    for r in rows:
        assert r["new_prediction"] != r["original_prediction"]
        assert 1 <= r["rank"] <= 3
    # ranks are ordered by change within an instance
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["rank"], r["change"]))
    for v in by.values():
        ch = [c for _, c in sorted(v)]
        assert ch == sorted(ch)


def test_whatif_defaults_unseen_and_blank(spark):
    scen = spark.createDataFrame([(1, "a", "2.0"), (1, "cat", "unseen"), (2, "a", ""), (2, "cat", "X"),
                                  (3, "a", None), (3, "cat", " X ")],
                                 "scenario_id long, feature string, value string")
    defaults = spark.createDataFrame([(0.5, 0.25)], "a__default double, cat__default double")
    scaler = spark.createDataFrame([(1.0, 2.0)], "a__mean double, a__std double")
    enc = spark.createDataFrame([("cat", 0, "W"), ("cat", 1, "X")], "feature string, code int, label string")
    rows = {r["scenario_id"]: r for r in
            W.build_rows(scen, ["a", "cat"], ["a"], ["cat"], defaults, scaler, enc).collect()}
    assert rows[1]["a"] == pytest.approx((2.0 - 1.0) / 2.0) and rows[1]["cat"] == 0.0   # unseen -> 0
    assert rows[2]["a"] == 0.5 and rows[2]["cat"] == 1.0                               # blank -> default
    assert rows[3]["a"] == 0.5 and rows[3]["cat"] == 1.0                               # null -> default


def test_permutation_importance_zero_for_unused_feature(spark):
    s = LinearScorer("s2", {"a": 2.0, "b": 0.0, "c": 0.0})
    df = _frame(spark, 150).withColumn("y", (F.col("a") > 0).cast("int"))
    imp = {r["feature"]: r["importance"] for r in X.permutation_importance(df, s, repeats=3).collect()}
    assert imp["b"] == 0.0 and imp["c"] == 0.0 and imp["a"] > 0.2


def test_forest_handles_many_categories(spark):
    from arbiter.operators import models as M
    rows = [(i, float(i % 7), f"cat{i % 60}", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y int")
    m = M.fit(df, "random_forest", "classification", "y", ["x"], ["c"])
    assert M.score(m, df).count() == 600


def test_with_key_is_stable(spark):
    from arbiter.operators.common import with_key
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, s string")
    a = sorted(r["id"] for r in with_key(df).collect())
    b = sorted(r["id"] for r in with_key(df).collect())
    assert a == b and len(set(a)) == 2
