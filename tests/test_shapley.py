"""Exact Shapley values against enumeration of all feature sets, and the class axis of the model operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from arbiter.operators import counterfactual as K
from arbiter.operators import explain as X
from arbiter.operators import models as M
from arbiter.operators import shapley as H
from arbiter.operators import whatif as W
from arbiter.operators.scorer import LinearScorer, ModelScorer, SoftmaxScorer

FEATS = ["a", "b", "c"]


def frame(spark, n=200, classes=2):
    r = random.Random(7)
    rows = []
    for i in range(n):
        a, b, c = r.uniform(-2, 2), r.gauss(0, 1), float(r.randrange(4))
        rows.append((i, a, b, c, "uvwx"[int(c)], int(a + 0.5 * c > 0.6) + (int(b > 0.8) if classes > 2 else 0)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, s string, y int")


def expected(nodes, x, inside):
    """Value of a set by the definition: follow the row for its features, else both children by their covers."""
    def walk(i):
        n = nodes[i]
        if n.left < 0:
            return np.array(n.value)
        if n.feature in inside:
            v = x[n.feature]
            left = v in n.categories if n.categories is not None else v <= n.threshold
            return walk(n.left if left else n.right)
        return sum(nodes[k].cover / n.cover * walk(k) for k in (n.left, n.right))
    return walk(0)


def enumerated(nodes, x):
    """features x classes, over all sets."""
    trees = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    m = len(x)
    value = {s: sum(expected(t, x, s) for t in trees.values()) / len(trees) for k in range(m + 1) for s in itertools.combinations(range(m), k)}
    phi = []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        phi.append(sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (value[tuple(sorted((*s, i)))] - value[s])
                       for k in range(m) for s in itertools.combinations(rest, k)))
    return np.array(phi), value[()]


@pytest.mark.parametrize("table", [H.TABLE, 0])
@pytest.mark.parametrize("kind", ["forest", "three classes", "tree", "regression", "categories"])
def test_trees_equal_enumeration(spark, monkeypatch, kind, table):
    monkeypatch.setattr(H, "TABLE", table)
    tr = frame(spark, classes=3 if kind == "three classes" else 2)
    names = ["a", "b", "c"]
    if kind == "categories":
        model = M.fit(tr, "random_forest", "classification", "y", ["a", "b"], ["s"])
        names = ["a", "b", "s"]
    else:
        est = {"forest": RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=5, seed=3), "tree": DecisionTreeClassifier(labelCol="y", maxDepth=4),
               "three classes": RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=6, seed=3),
               "regression": RandomForestRegressor(labelCol="b", numTrees=3, maxDepth=4, seed=3)}[kind]
        model = Pipeline(stages=[VectorAssembler(inputCols=["a", "c"] if kind == "regression" else FEATS, outputCol="features"), est]).fit(tr)
        names = ["a", "c"] if kind == "regression" else FEATS
    nodes = H.forest_nodes(model.stages[-1]).collect()
    if kind == "categories":
        assert any(n.categories is not None and n.left >= 0 for n in nodes)
    te = tr.where("id < 12")
    got = H.model_shapley(te, model, names).collect()
    classes = sorted({r["class"] for r in got})
    assert classes == {"three classes": [0, 1, 2], "regression": [0]}.get(kind, [1])
    out = {r["id"]: r for r in model.transform(te).collect()}
    for i, row in out.items():
        phi, base = enumerated(nodes, row["features"].toArray())
        mine = {(r["feature"], r["class"]): r for r in got if r["id"] == i}
        for k in classes:
            assert [mine[f, k]["phi"] for f in names] == pytest.approx([p[k] for p in phi], abs=1e-12)
            assert mine[names[0], k]["base_value"] == pytest.approx(base[k])
            own = row["prediction"] if kind == "regression" else row["probability"][k]
            assert mine[names[0], k]["prediction"] == pytest.approx(own)


def test_odd_rows_and_hand_made_trees(spark):
    tr = frame(spark, 50)
    tree = [(0, 0, 1, 2, 0, 0.0, None, None, 0.0, [0.5]), (0, 1, 3, 4, 0, -1.0, None, None, 0.0, [0.5]), (0, 2, -1, -1, None, None, None, None, 0.0, [3.0]),
            (0, 3, -1, -1, None, None, None, None, 0.0, [1.0]), (0, 4, -1, -1, None, None, None, None, 0.0, [2.0])]
    nodes = H.with_covers(spark.createDataFrame(tree, H.NODES), tr, FEATS)
    assert {n.node: n.cover for n in nodes.collect()}[0] == 50
    te = spark.createDataFrame([(1, None, 1.0, None), (2, -0.0, None, 1.0), (2, -5.0, 0.0, 0.0), (None, 9.0, 0.0, 0.0)], "id long, a double, b double, c double")
    got = H.tree_shapley(te, nodes, FEATS).collect()
    assert sorted(r["prediction"] for r in got if r["feature"] == "a") == pytest.approx([1.0, 2.0, 3.0, 3.0])  # a missing value goes right
    assert all(r["phi"] == 0 for r in got if r["feature"] != "a") and len(got) == 12
    assert H.tree_shapley(te.limit(0), nodes, FEATS).collect() == []


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_NODES", 1)
    with pytest.raises(ValueError, match="nodes"):
        H.flatten(spark.createDataFrame([(0, 0, 1, 2, 0, 0.0, None, None, 1.0, [1.0]), (0, 1, -1, -1, None, None, None, None, 1.0, [1.0])], H.NODES))
    many = LinearScorer("many", {f"f{i}": 1.0 for i in range(13)})
    with pytest.raises(ValueError, match="sampled_shapley"):
        H.exact_shapley(frame(spark, 5), many, frame(spark, 5))


def test_exact_values_of_a_linear_scorer(spark):
    """Against the whole background they are the closed form."""
    tr, te = frame(spark, 40), frame(spark, 60).where("id >= 50")
    s = LinearScorer("linear", {"a": 1.5, "b": -0.7, "c": 0.2}, 0.3, link="identity")
    got = {(r["id"], r["feature"]): r for r in H.exact_shapley(te, s, tr).collect()}
    for r in X.linear_shap(te, s, tr).collect():
        g = got[r["id"], r["feature"]]
        assert (g["phi"], g["base_value"], g["prediction"]) == pytest.approx((r["phi"], r["base_value"], r["z"]))
    assert len(got) == 30


def test_exact_values_of_a_model_and_of_classes(spark):
    tr, te = frame(spark, 120, 3), frame(spark, 6, 3)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"), LogisticRegression(labelCol="y", regParam=0.1)]).fit(tr)
    s = ModelScorer("three", model, FEATS)
    lr = model.stages[-1]
    soft = SoftmaxScorer("soft", tuple(dict(zip(FEATS, map(float, row))) for row in lr.coefficientMatrix.toArray()), tuple(map(float, lr.interceptVector)))
    assert s.n_classes == soft.n_classes == 3
    a, b = ({(r["id"], r["class"], r["feature"]): (r["phi"], r["base_value"], r["prediction"]) for r in H.exact_shapley(te, x, tr, rows=7, classes=3).collect()} for x in (s, soft))
    assert set(a) == set(b) and len(a) == 6 * 3 * 3
    for k in a:
        assert a[k] == pytest.approx(b[k])
        assert sum(a[k[0], c, k[2]][0] for c in range(3)) == pytest.approx(0, abs=1e-12)  # probabilities sum to 1
    one = {(r["id"], r["feature"]): r["phi"] for r in H.exact_shapley(te, s.for_class(2), tr, rows=7).collect()}
    assert all(one[i, f] == pytest.approx(a[i, 2, f][0]) for i, f in one)


def test_scorers_of_three_classes_agree(spark):
    tr, te = frame(spark, 150, 3), frame(spark, 40, 3).where("id >= 20")
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"), LogisticRegression(labelCol="y", regParam=0.1)]).fit(tr)
    lr = model.stages[-1]
    s = ModelScorer("x", model, FEATS)
    soft = SoftmaxScorer("x", tuple(dict(zip(FEATS, map(float, row))) for row in lr.coefficientMatrix.toArray()), tuple(map(float, lr.interceptVector)))

    def rows(df, *order):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.orderBy(*order).collect()]
    scen = te.withColumnRenamed("id", "scenario_id")
    for run in (lambda x: rows(W.predict(scen, x), "scenario_id"), lambda x: rows(W.predict_classes(scen, x), "scenario_id", "rank"),
                lambda x: rows(W.compare(scen, [x]), "scenario_id"), lambda x: rows(W.sensitivity(scen, x, "a", -1, 1, 3), "scenario_id", "step"),
                lambda x: rows(K.find(te, tr, x, ["a", "b"], ["c"], target=1), "id", "rank"),
                lambda x: rows(K.explain_flip(K.find_packed(te, tr, x, ["a", "b"], ["c"])), "id"),
                lambda x: rows(X.permutation_importance_by_class(te, x, repeats=2), "class", "feature")):
        assert run(s) == run(soft)
    p = {r["scenario_id"]: r for r in W.predict(scen, s).collect()}
    best = {}
    for r in W.predict_classes(scen, s).collect():
        if r["rank"] == 1:
            best[r["scenario_id"]] = (r["class"], r["probability"])
    assert best == {i: (r["prediction"], r["confidence"]) for i, r in p.items()}
    flips = K.find(te, tr, s, ["a", "b"], ["c"], target=1).collect()
    assert flips and all(r["new_prediction"] == 1 != r["original_prediction"] for r in flips)


def test_explain_chooses_the_exact_method(spark):
    tr, te = frame(spark, 120, 3), frame(spark, 8, 3)
    va = VectorAssembler(inputCols=FEATS, outputCol="features")
    forest = ModelScorer("f", Pipeline(stages=[va, RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=3, seed=1)]).fit(tr), FEATS)
    logit = ModelScorer("l", Pipeline(stages=[va, LogisticRegression(labelCol="y")]).fit(tr), FEATS)
    for s, method in ((forest, "tree_shapley"), (logit, "exact_shapley")):
        got = X.explain(te, s, tr)
        assert {"class", "base_value", "prediction", "value", "phi", "rank", "method"} <= set(got.columns)
        sums = got.groupBy("id", "class").agg(F.sum("phi").alias("s"), F.first("base_value").alias("b"), F.first("prediction").alias("p"),
                                              F.collect_set("rank").alias("r"), F.first("method").alias("m")).collect()
        prob = {r["id"]: r["prob"] for r in s.apply_classes(te).collect()}
        assert len(sums) == 24 and all(r["m"] == method and sorted(r["r"]) == [1, 2, 3] for r in sums)
        assert all(r["s"] + r["b"] == pytest.approx(prob[r["id"]][r["class"]]) == pytest.approx(r["p"]) for r in sums)
    sampled = X.explain(te, logit, tr, samples=2)
    assert {"class", "phi_se"} <= set(sampled.columns) and sampled.count() == 8 * 3 * 3


def test_rows_of_a_cell_are_computed_once_a_batch(spark):
    """Rows that agree in all bins come to neighbouring rows, a cell of most rows to several tasks."""
    nodes = spark.createDataFrame([(0, 0, 1, 2, 0, 0.5, None, None, 2.0, [0.5, 0.5]), (0, 1, -1, -1, None, None, None, None, 1.0, [0.8, 0.2]),
                                   (0, 2, -1, -1, None, None, None, None, 1.0, [0.1, 0.9])], H.NODES)
    df = spark.range(4000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("id"), (F.col("id") % 10 == 0).cast("double").alias("a"), F.rand(1).alias("b")).repartition(8)
    rows = df.select(F.col("id").alias("_key"), F.array("a", "b").alias("_x"))
    shipped = spark.sparkContext.broadcast(H.flatten(nodes))
    parts = [[bytes(c) for c in p] for p in H.by_cells(rows, shipped, 2).rdd.map(lambda r: r["_cell"]).glom().collect()]
    assert sum(map(len, parts)) == 4000 and len(set(sum(parts, []))) == 2
    assert sum(len(set(p)) for p in parts) <= sum(1 for p in parts if p) + 1  # cells that tasks compute
    assert max(map(len, parts)) < 2000
    got = H.tree_shapley(df, nodes, ["a", "b"])
    assert got.count() == 8000 and got.where("id is null").count() == 2 * 572
    assert {(r["feature"], r["value"] > 0.5 if r["feature"] == "a" else None, round(r["phi"], 9)) for r in got.collect()} == {
        ("a", False, -0.35), ("a", True, 0.35), ("b", None, 0.0)}


class _Rows:
    """A scorer seen only through the protocol that every scorer has."""

    def __init__(self, s):
        self.features, self.apply, self.apply_classes = s.features, s.apply, s.apply_classes


@pytest.mark.parametrize("classes", [0, 3])
def test_exact_values_are_summed_in_the_task(spark, classes):
    """A row leaves its task once, not once for every background row and set; nulls and repeated keys count as in the sums of rows."""
    coef = ({"a": 1.5, "b": -0.7, "c": 0.2}, {"a": -0.3, "b": 0.4, "c": 0.1}, {"a": 0.2, "b": 0.1, "c": -0.6})
    s = SoftmaxScorer("soft", coef, (0.1, 0.2, -0.3)) if classes else LinearScorer("one", coef[0], 0.3)
    rows = "id long, a double, b double, c double"
    tr = spark.createDataFrame([(i, i * 0.3, None if i == 4 else 1.0 - i, 0.5 * i) for i in range(9)], rows)
    te = spark.createDataFrame([(1, 0.5, 1.0, -2.0), (2, None, 1.0, 0.5), (3, 1.0, 2.0, 3.0), (3, None, 2.0, -3.0), (3, 0.0, 0.1, 0.2),
                                (4, None, None, None), (5, float("nan"), 1.0, 1.0), (6, 900.0, -900.0, 0.0), (None, 0.1, 0.2, 0.3)], rows)

    def found(scorer, bg):
        return {(r["id"], r["class"] if classes else 0, r["feature"]): (r["phi"], r["base_value"], r["prediction"])
                for r in H.exact_shapley(te, scorer, bg, rows=6, classes=classes).collect()}

    for bg in (tr, tr.where("id = 4")):
        got, want = found(s, bg), found(_Rows(s), bg)
        assert set(got) == set(want) and len(got) == 7 * (classes or 1) * 3
        for k in want:
            assert [v is None for v in got[k]] == [v is None for v in want[k]]
            assert [v for v in got[k] if v is not None] == pytest.approx([v for v in want[k] if v is not None], nan_ok=True)
    assert found(s, tr.limit(0)) == {}
    plan = H.exact_shapley(te, s, tr, classes=classes)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" not in plan and "MapInArrow" in plan
