"""Outcome mapping and audit log fixtures from the reference's feature tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from arbiter.operators import audit as A
from arbiter.operators import decide as D


def test_outcome_mapping(spark):
    log = D.outcome_log(spark, [("customer_churn", "Customer will churn", "Customer will stay",
                                 "Send retention offer", "Standard engagement", "", 1)])
    preds = spark.createDataFrame([(0, "customer_churn", 1, 0.85), (1, "customer_churn", 0, 0.92),
                                   (2, "unknown", 1, 0.5)], "id long, outcome string, pred int, confidence double")
    r = {x["id"]: x for x in D.actions(preds, D.current_outcomes(log)).collect()}
    assert r[0]["label"] == "Customer will churn" and r[0]["action"] == "Send retention offer"
    assert r[1]["label"] == "Customer will stay"
    assert r[2]["action"] is None and r[2]["error"] == "Outcome 'unknown' not defined"


def test_upsert_latest_version_wins(spark):
    log = D.outcome_log(spark, [("a", "p", "n", "x", "y", "old", 1), ("a", "p", "n", "x2", "y2", "new", 2)])
    r = D.current_outcomes(log).collect()
    assert len(r) == 1 and r[0]["description"] == "new"


def test_decision_matrix_two_rows(spark):
    log = D.outcome_log(spark, [("a", "P", "N", "act", "wait", "d", 1)])
    m = {x["prediction"]: x for x in D.decision_matrix(D.current_outcomes(log)).collect()}
    assert m[1]["action"] == "act" and m[0]["action"] == "wait"


def test_audit_fixture(spark):
    t0 = dt.datetime(2024, 1, 1)
    preds = spark.createDataFrame([(t0, 0, 1, 0.85, 0.82, "m"), (t0, 1, 0, 0.32, 0.68, "m")],
                                  "ts timestamp, id long, pred int, p double, confidence double, model string")
    ev = A.prediction_events(preds, action=None)
    th = A.threshold_events(spark.createDataFrame([(t0, "m", 0.5, 0.6)], "ts timestamp, model string, o double, n double"),
                            "ts", "model", "o", "n")
    ac = A.action_events(spark.createDataFrame([(t0, 0, "call")], "ts timestamp, pid long, a string"), "ts", "pid", "a")
    log = ev.unionByName(th).unionByName(ac)
    s = A.statistics(log).first()
    assert s["total_predictions"] == 2 and s["total_records"] == 4
    assert s["avg_confidence"] == pytest.approx(0.75)
    levels = {r["record_id"]: r["confidence_level"] for r in ev.collect()}
    assert levels == {0: "High", 1: "Medium"}
    trail = A.trail(log, spark.createDataFrame([(0,)], "id long")).collect()
    assert sorted(r["event_type"] for r in trail) == ["action_taken", "prediction"]


def test_statistics_without_predictions(spark):
    t0 = dt.datetime(2024, 1, 1)
    th = A.threshold_events(spark.createDataFrame([(t0, "m", 0.5, 0.6)], "ts timestamp, model string, o double, n double"),
                            "ts", "model", "o", "n")
    assert A.statistics(th).first()["total_records"] == 0


def test_batch_index_per_row(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0, i, 1, 0.9, 0.9, "m", "b" if i < 3 else "c") for i in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp, id long, pred int, p double, confidence double, model string, g string")
    ev = A.batch_events(df, F.col("g"), action=None)
    got = {r["record_id"]: (r["metadata"]["batch_id"], r["metadata"]["batch_index"]) for r in ev.collect()}
    assert got == {0: ("b", "0"), 1: ("b", "1"), 2: ("b", "2"), 3: ("c", "0"), 4: ("c", "1")}


def test_audit_table_append_load_clear(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    preds = spark.createDataFrame([(t0, 0, 1, 0.85, 0.82, "m")],
                                  "ts timestamp, id long, pred int, p double, confidence double, model string")
    path = str(tmp_path / "audit")
    A.append(A.prediction_events(preds, action=None), path)
    A.append(A.prediction_events(preds, action=None), path)
    assert A.load(spark, path).count() == 2
    A.clear(spark, path)
    assert A.load(spark, path).count() == 0


def test_outcomes_export_import(spark, tmp_path):
    log = D.outcome_log(spark, [("a", "P", "N", "act", "wait", "d", 1)])
    back = D.import_outcomes(spark, D.export_outcomes(log, str(tmp_path / "o")))
    assert back.collect()[0]["positive_action"] == "act"


def test_audit_report_text(spark):
    t0 = dt.datetime(2024, 1, 1, 8, 30)
    preds = spark.createDataFrame([(t0, 0, 1, 0.9, 0.9, "m"), (t0 + dt.timedelta(days=1), 1, 0, 0.3, 0.7, "m")],
                                  "ts timestamp, id long, pred int, p double, confidence double, model string")
    text = A.report(A.statistics(A.prediction_events(preds, action=None))).first()["report"]
    assert text.startswith("=== AUDIT LOG REPORT ===")
    assert "- Total Predictions: 2" in text and "- Avg Confidence: 0.800" in text
    assert "- High Confidence: 1 (50.0%)" in text and "- Medium Confidence: 1 (50.0%)" in text
    assert "2024-01-01T08:30:00 to 2024-01-02T08:30:00" in text
