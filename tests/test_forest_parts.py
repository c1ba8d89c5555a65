"""Forests of many training rows are grown some trees at a time, so that what MLlib keeps of a row is bounded."""

from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor

from arbiter.operators import models as M
from arbiter.operators.shapley import model_shapley


def frame(spark, n=200):
    rows = [(i, float(i * 7 % 31), float(i * 5 % 13), "abc"[i % 3], int(i * 7 % 31 + i * 5 % 13 > 20), float(i * 7 % 31) * 2 + i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y int, v double")


@pytest.fixture()
def grown(monkeypatch):
    """What each fit of an MLlib forest was asked for: trees, seed and checkpoints of the rows' nodes."""
    asked = []
    for kind in (RandomForestClassifier, RandomForestRegressor):
        def fit(self, df, own=kind._fit):
            asked.append((self.getNumTrees(), self.getSeed(), self.getCheckpointInterval()))
            return own(self, df)
        monkeypatch.setattr(kind, "_fit", fit)
    monkeypatch.setattr(M, "FOREST_TREES", 7)
    monkeypatch.setattr(M, "FOREST_PART", 3, raising=False)
    return asked


@pytest.mark.parametrize("task,label", [("classification", "y"), ("regression", "v")])
def test_trees_of_many_rows_are_grown_in_parts(spark, grown, monkeypatch, tmp_path, task, label):
    monkeypatch.setattr(M, "FOREST_ROWS", 50)
    df = frame(spark)
    m = M.fit(df, "random_forest", task, label, ["a", "b"], ["c"])
    assert [(n, kept) for n, _, kept in grown] == [(3, -1), (3, -1), (1, -1)] and len({s for _, s, _ in grown}) == 3
    forest = m.stages[-1]
    assert forest.getNumTrees == forest.getOrDefault("numTrees") == len(forest.trees) == 7 and forest.getSeed() == M.SEED
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) > 3  # not one part three times
    scores = {r["id"]: r for r in M.score(m, df, label=label, task=task).collect()}
    if task == "classification":
        assert sum(r["pred"] == r["y"] for r in scores.values()) > 180
    else:
        assert sum(abs(r["pred"] - r["v"]) for r in scores.values()) / len(scores) < 3
    m.write().overwrite().save(str(tmp_path / "m"))
    assert {r["id"]: r for r in M.score(PipelineModel.load(str(tmp_path / "m")), df, label=label, task=task).collect()} == scores
    values = model_shapley(df.limit(5), m, ["a", "b", "c"]).collect()
    key = "p" if task == "classification" else "pred"
    assert all(r["prediction"] == pytest.approx(scores[r["id"]][key]) for r in values if task == "regression" or r["class"] == 1)


def test_a_join_of_labels_is_made_once_for_all_parts(spark, grown, monkeypatch):
    seen, grow = [], M.ForestInParts._grow
    monkeypatch.setattr(M.ForestInParts, "_grow", lambda self, df: seen.append((df.columns, df.is_cached)) or grow(self, df))
    monkeypatch.setattr(M, "FOREST_ROWS", 50)
    monkeypatch.setattr(M, "MAX_LABELS", 2)  # the labels of c are joined
    df = frame(spark)
    m = M.fit(df, "random_forest", "classification", "y", ["a", "b"], ["c"])
    assert seen == [(["label", "features"], True)] and len(m.stages[-1].trees) == 7
    assert sum(r["pred"] == r["y"] for r in M.score(m, df).collect()) > 180
    M.fit(df, "random_forest", "classification", "y", ["a", "b"], [])
    assert not seen[1][1]


def test_trees_of_few_rows_are_grown_at_once(spark, grown):
    M.fit(frame(spark), "random_forest", "classification", "y", ["a", "b"], ["c"])
    assert grown == [(7, M.SEED, 10)]
