"""The joined label encoder: codes, persistence, and its use for columns of many labels."""

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from arbiter.operators import encoders as N
from arbiter.operators import models as M
from arbiter.session import scratch_path

SCHEMA = "id long, s string, t string, y int, v double"


def frame(spark, n=400, labels=60, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *[f"common-prefix-{k:04d}" for k in range(labels)]]), r.choice(["x", "Ünï", "", "y "]), r.randrange(2), r.random()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_codes_are_the_indexers(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 40)  # so that the labels are cut
    monkeypatch.setattr(N, "CUTS", 7)
    df = frame(spark)
    mine = N.TableIndexer(["s", "t"], ["s2", "t2"]).fit(df)
    theirs = Pipeline(stages=[StringIndexer(inputCol=c, outputCol=f"{c}1", stringOrderType="alphabetAsc", handleInvalid="keep") for c in ("s", "t")]).fit(df)
    more = df.unionByName(spark.createDataFrame([(-1, "never seen", "zz", 0, 0.0), (-2, None, None, 0, 0.0)], SCHEMA))
    got = mine.transform(theirs.transform(more))
    assert got.count() == 402 and got.where("s1 <> s2 or t1 <> t2").count() == 0
    assert got.columns[-2:] == ["s2", "t2"]


def test_order_by_mean(spark):
    df = frame(spark)
    got = {r["label"]: r["code"] for r in N.label_table(df, ["s"], "v").collect()}
    means = {}
    for r in df.collect():
        if r["s"] is not None:
            means.setdefault(r["s"], []).append(r["v"])
    want = sorted(means, key=lambda k: (sum(means[k]) / len(means[k]), k))
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == want


def test_saved_with_the_pipeline(spark):
    df = frame(spark)
    model = Pipeline(stages=[N.TableIndexer(["s"], ["s__idx"], "v"), VectorAssembler(inputCols=["s__idx"], outputCol="features"), LinearRegression(labelCol="v")]).fit(df)
    path = scratch_path(spark, "pipe")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    rows = lambda m: sorted((r["id"], r["s__idx"], r["prediction"]) for r in m.transform(df).collect())
    assert rows(model) == rows(back) and back.stages[0].getOrDefault("meanOf") == "v"


def test_empty_table(spark):
    df = frame(spark, 1).limit(0)
    model = N.TableIndexer(["s"], ["k"]).fit(df)
    assert model.transform(df).count() == 0
    assert [r["k"] for r in model.transform(frame(spark, 3)).collect()] == [0.0] * 3


def test_models_of_many_labels(spark, monkeypatch):
    """The joined codes give the logistic model of the collected ones; a forest's columns aren't hashed."""
    df = frame(spark, 600, 40)
    plain = M.fit(df, "logistic_regression", "classification", "y", ["v"], ["s", "t"])
    monkeypatch.setattr(M, "MAX_LABELS", 20)
    joined = M.fit(df, "logistic_regression", "classification", "y", ["v"], ["s", "t"])
    assert [type(s).__name__ for s in joined.stages].count("TableIndexerModel") == 1
    a, b = ({r["id"]: r["p"] for r in M.score(m, df).collect()} for m in (plain, joined))
    assert len(a) == 600 and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    forest = M.fit(df.withColumn("y", (F.substring("s", -1, 1) > "4").cast("int")).na.fill(0, ["y"]), "random_forest", "classification", "y", ["v"], ["s"])
    s = M.score(forest, df.withColumn("y", (F.substring("s", -1, 1) > "4").cast("int")).na.fill(0, ["y"]))
    # labels ordered by their mean: the two halves of the labels are apart by one threshold (null has its own code)
    assert s.where("s.pred = y").count() > 0.95 * 600 if "s" in s.columns else s.where("pred = y").count() > 0.9 * 600
