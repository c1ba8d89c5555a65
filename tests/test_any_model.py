"""The explanation, what-if and counterfactual operators with fitted models, and the full modelling run."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from arbiter.operators import counterfactual as K
from arbiter.operators import explain as X
from arbiter.operators import whatif as W
from arbiter.operators.pipeline import run_pipeline
from arbiter.operators.scorer import LinearScorer, ModelScorer, linear_from_model

FEATS = ["a", "b", "c"]


def frame(spark, n=160, offset=0):
    rows = [(i + offset, math.sin(i) * 2, math.cos(i * 0.7), float(i % 3), int(math.sin(i) + 0.3 * (i % 3) > 0.2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


@pytest.fixture(scope="module")
def models(spark):
    tr = frame(spark).cache()
    va = VectorAssembler(inputCols=FEATS, outputCol="features")
    forest = Pipeline(stages=[va, RandomForestClassifier(labelCol="y", numTrees=8, maxDepth=4, seed=1)]).fit(tr)
    logistic = Pipeline(stages=[va, LogisticRegression(labelCol="y")]).fit(tr)
    return {"train": tr, "forest": ModelScorer("forest", forest, FEATS), "logistic": ModelScorer("logistic", logistic, FEATS),
            "linear": linear_from_model("linear", logistic.stages[-1], FEATS)}


def rows(df, *order):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.orderBy(*order).collect()]


def test_linear_scorer_of_a_fitted_model(models):
    a = models["linear"].apply(models["train"]).select("id", "p", "pred")
    b = models["logistic"].apply(models["train"]).select("id", "p", "pred")
    assert rows(a, "id") == rows(b, "id")


@pytest.mark.parametrize("op", ["permutation", "shapley", "find", "multiple", "flip", "sensitivity", "recommend"])
def test_in_row_and_exploded_forms_agree(spark, models, op):
    """The same logistic model as a columnar scorer and as a fitted pipeline."""
    tr, te = models["train"], frame(spark, 25, 5000)
    one = spark.createDataFrame([(0.0, 1.0, -2.0, 2.0, 0.0, 1.0, -1.0, 1.0)],
                                "a__mean double, a__std double, a__min double, a__max double, b__mean double, b__std double, b__min double, b__max double")
    scen = te.withColumnRenamed("id", "scenario_id")
    run = {"permutation": lambda s: rows(X.permutation_importance(te, s, repeats=3), "feature"),
           "shapley": lambda s: rows(X.sampled_shapley(te, s, tr, samples=3), "id", "feature"),
           "find": lambda s: rows(K.find(te, tr, s, ["a", "b"], ["c"]), "id", "rank"),
           "multiple": lambda s: rows(K.find_multiple(te, tr, s, ["a", "b"], ["c"]), "id", "rank"),
           "flip": lambda s: rows(K.explain_flip(K.find_packed(te, tr, s, ["a", "b"], ["c"])), "id"),
           "sensitivity": lambda s: rows(K.sensitivity_to_flip(te, tr, s, ["a", "b"], ["c"]), "id", "rank"),
           "recommend": lambda s: rows(W.recommend(scen, s, 1, one.select("a__min", "a__max", "b__min", "b__max"),
                                                   one.select("a__mean", "a__std", "b__mean", "b__std"), ["a", "b"], 4), "scenario_id", "rank")}[op]
    got = run(models["linear"])
    assert got and got == run(models["logistic"])


def test_operators_run_with_a_forest(spark, models):
    tr, te, s = models["train"], frame(spark, 12, 9000), models["forest"]
    imp = {r["feature"]: r["importance"] for r in X.permutation_importance(te, s, repeats=2).collect()}
    assert set(imp) == set(FEATS) and max(imp, key=imp.get) == "a"
    for r in K.find(te, tr, s, ["a", "b"], ["c"]).collect():
        assert r["new_prediction"] != r["original_prediction"] and r["num_found"] >= r["rank"]
    scen = te.withColumnRenamed("id", "scenario_id")
    assert {r["model"] for r in W.compare(scen, [s, models["linear"]]).collect()} == {"forest", "linear"}
    assert W.predict(scen, s).count() == 12 and W.sensitivity(scen, s, "a", -1, 1, 5).count() == 60
    full = X.explain(te, s, tr, samples=4)
    assert {"base_value", "prediction", "value", "phi", "phi_se", "rank", "method"} <= set(full.columns)
    assert full.select("method").distinct().collect()[0][0] == "sampled_shapley"


def test_shapley_sums_to_the_difference_of_predictions(spark, models):
    """Exactly, per row: with one background row there is nothing to sample."""
    te, one = frame(spark, 20, 7000), frame(spark, 1, 3)
    for s in (models["linear"], models["forest"]):
        total = {r["id"]: r["t"] for r in X.sampled_shapley(te, s, one, samples=3).groupBy("id").agg(F.sum("phi").alias("t")).collect()}
        base = s.apply(one).first()["p"]
        for r in s.apply(te).collect():
            assert total[r["id"]] == pytest.approx(r["p"] - base, abs=1e-9)


def test_explain_methods(spark, models):
    te = frame(spark, 5, 100)
    lin = X.explain(te, models["linear"], models["train"]).collect()
    assert {r["method"] for r in lin} == {"linear_shap"} and len(lin) == 15
    none = X.explain(te, LinearScorer("none", {}), models["train"]).collect()
    assert {r["method"] for r in none} == {"fallback_no_shap"} and all(r["phi"] == 0.0 for r in none)


def test_permutation_importance_of_a_regression(spark):
    df = frame(spark).withColumn("t", 3 * F.col("a") + 0.5 * F.col("b"))
    va = VectorAssembler(inputCols=FEATS, outputCol="features")
    s = ModelScorer("ols", Pipeline(stages=[va, LinearRegression(labelCol="t")]).fit(df), FEATS, task="regression")
    imp = {r["feature"]: r["importance"] for r in X.permutation_importance(df, s, "t", repeats=3, scoring="r2").collect()}
    assert imp["a"] > 0.5 > imp["b"] > imp["c"] - 1e-9


def test_counterfactual_importance_units_and_chunks(spark, models, monkeypatch):
    tr, te, s = models["train"], frame(spark, 20, 400), models["linear"]
    scaler = spark.createDataFrame([(10.0, 2.0, 0.0, 1.0)], "a__mean double, a__std double, b__mean double, b__std double")
    got = K.find(te, tr, s, ["a", "b"], ["c"], scaler=scaler, importance={"a": 1.0, "b": 0.5}).collect()
    assert got and {r["feature"] for r in got} <= {"a", "b"}
    for r in got:
        k = 2.0 if r["feature"] == "a" else 1.0
        assert r["change_unscaled"] == pytest.approx(k * r["change"])
    want = rows(K.find(te, tr, s, ["a", "b"], ["c"]), "id", "rank")
    monkeypatch.setattr(K, "MAX_CANDIDATES", 3)  # the list in several chunks
    assert rows(K.find(te, tr, s, ["a", "b"], ["c"]), "id", "rank") == want


def source(spark, n=240):
    data = [(i, float(i % 17), None if i % 3 else 1.0, "uvw"[i % 3] if i % 9 else None, ["no", "yes", "maybe"][(i // 2) % 3], float(i * i % 101))
            for i in range(n)]
    return spark.createDataFrame(data, "id long, x double, gap double, c string, t string, v double")


def test_run_pipeline(spark):
    src = source(spark)
    multi = {r["model"]: r for r in run_pipeline(src, "t", ["logistic_regression", "nope"]).collect()}
    ok = multi["logistic_regression"]
    assert (ok["status"], ok["task_type"], ok["feature_names"]) == ("success", "classification", "x,v,c")
    assert ok["n_train"] + ok["n_test"] == src.where("c is not null").count()  # 'gap' goes, then rows without c
    assert ok["accuracy"] is not None and ok["roc_auc"] is not None and ok["r2"] is None
    assert multi["nope"]["status"] == "failed" and "nope" in multi["nope"]["error"]
    binary = run_pipeline(src.where("t <> 'maybe'"), "t", ["logistic_regression"]).first()
    assert binary["status"] == "success" and 0 <= binary["roc_auc"] <= 1
    reg = run_pipeline(src, "v", ["logistic_regression"]).first()
    assert (reg["task_type"], reg["accuracy"]) == ("regression", None) and reg["rmse"] > 0


def test_run_pipeline_failures(spark):
    src = source(spark)
    for df, target, reason in ((src, "zzz", "not found"), (src.limit(0), "t", "empty"), (src.limit(5), "t", "10 rows"), (src, "gap", "missing")):
        r = run_pipeline(df, target).collect()
        assert len(r) == 1 and r[0]["status"] == "failed" and reason in r[0]["error"]
    r = run_pipeline(src, "t", ["nope"]).collect()
    assert [x["status"] for x in r] == ["failed"]


def test_full_run_with_columns_called_y(spark):
    """The target may be called y, and so may a feature."""
    df = frame(spark, 200)
    one = run_pipeline(df, "y", ["logistic_regression"]).first()
    other = run_pipeline(df.withColumnRenamed("y", "t").withColumnRenamed("a", "y"), "t", ["logistic_regression"]).first()
    assert one["status"] == other["status"] == "success" and one["accuracy"] == pytest.approx(other["accuracy"]) and one["accuracy"] > 0.8
    assert one["feature_names"] == "a,b,c" and other["feature_names"] == "y,b,c"


def test_forest_rows_a_task_are_bounded(spark, monkeypatch):
    """A training frame of few partitions is spread by its number of rows before a forest keeps them; a small one stays."""
    from arbiter.operators import models as M
    seen = []

    class Fitted:
        def fit(self, t):
            seen.append((t.rdd.getNumPartitions(), t.count(), t.select("id").distinct().count()))
    monkeypatch.setattr(M, "build_pipeline", lambda *a, **k: Fitted())
    monkeypatch.setattr(M, "FOREST_ROWS", 10, raising=False)
    tr = frame(spark, 200).coalesce(1)
    M.fit(tr, "random_forest", "classification", "y", FEATS, [])
    M.fit(tr, "random_forest", "regression", "a", ["b"], [])
    M.fit(tr, "logistic_regression", "classification", "y", FEATS, [])
    monkeypatch.setattr(M, "FOREST_ROWS", 200)
    M.fit(tr, "random_forest", "classification", "y", FEATS, [])
    assert seen == [(20, 200, 200), (20, 200, 200), (1, 200, 200), (1, 200, 200)]


def test_full_run_scores_its_rows_once(spark, monkeypatch):
    """A model scores each test row once, not again for every metric."""
    from arbiter.operators import models as M
    scored, score = spark.sparkContext.accumulator(0), M.score

    def count(batches):
        for b in batches:
            scored.add(b.num_rows)
            yield b

    def counted(*args, **kwargs):
        out = score(*args, **kwargs)
        return out.mapInArrow(count, out.schema)
    monkeypatch.setattr(M, "score", counted)
    r = run_pipeline(frame(spark, 120), "y", ["logistic_regression"]).collect()[0]
    assert r["status"] == "success" and r["roc_auc"] is not None
    assert scored.value == r["n_test"]
