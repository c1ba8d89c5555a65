"""What fails while models are trained: a model that refuses the rows is a result, a job that breaks down is not."""

from __future__ import annotations

import pytest

from arbiter.operators import models as M
from arbiter.operators import profile
from arbiter.operators.pipeline import run_pipeline
from arbiter.plans import q_models as Q


def frame(spark, n=60):
    rows = [(i, float(i % 13), float(i % 7), float(i * 3 % 11), "ab"[i % 2], "xyz"[i % 3], int(i % 13 > 6)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, o_totalprice double, c_acctbal double, o_custkey double, c_mktsegment string, o_orderstatus string, y int")


def broken(df):
    """``df`` whose rows can't be read: the disk is full."""
    def read(batches):
        for _ in batches:
            raise OSError(28, "No space left on device")
        yield from ()
    return df.mapInArrow(read, df.schema)


def train(df, names=("logistic_regression", "nope")):
    return M.train_all(df, names, "classification", "y", ["o_totalprice", "c_acctbal"], ["c_mktsegment"])


def test_a_broken_job_is_raised(spark, monkeypatch):
    with pytest.raises(Exception, match="No space left on device"):
        train(broken(frame(spark)))

    def fit(*args):
        raise RuntimeError("an executor was lost")
    monkeypatch.setattr(M, "fit", fit)
    with pytest.raises(RuntimeError, match="lost"):
        train(frame(spark))


def test_a_model_that_refuses_the_rows_is_a_result(spark):
    models, status = train(frame(spark))
    assert list(models) == ["logistic_regression"]
    assert status == [("logistic_regression", "success", None), ("nope", "failed", "ValueError: Unknown model: nope")]
    for df, why in ((frame(spark).selectExpr("* except (y)", "nullif(y, 1) AS y"), "Null"), (frame(spark).limit(0), "no rows")):
        models, status = train(df)
        assert not models and [s for _, s, _ in status] == ["failed"] * 2 and why in status[0][2]


def test_a_full_run_raises_what_broke_down(spark, monkeypatch):
    monkeypatch.setattr(profile, "drop_missing", broken)
    with pytest.raises(Exception, match="No space left on device"):
        run_pipeline(frame(spark), "y", ["logistic_regression"])


def test_train_scores_has_every_model_or_none(spark, monkeypatch):
    df, fit = frame(spark), M.fit
    monkeypatch.setattr(Q, "_raw_split", lambda *a: (df, df))
    monkeypatch.setattr(M, "FOREST_TREES", 3)
    got = {(r["model"], r["task"]) for r in Q.model_train_scores(spark, "").collect()}
    assert got == {("logistic_regression", "classification"), ("random_forest", "classification"), ("linear_regression", "regression")}

    def no_forest(t, name, *args):
        if name == "random_forest":
            raise ValueError("no forest today")
        return fit(t, name, *args)
    monkeypatch.setattr(M, "fit", no_forest)
    with pytest.raises(RuntimeError, match="random_forest: ValueError: no forest today"):
        Q.model_train_scores(spark, "")
