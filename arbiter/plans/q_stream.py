"""Streaming queries (STR1, STR2): run to completion, return the sink as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators.common import attach
from arbiter.operators.decide import current_outcomes, outcome_log
from arbiter.plans.frames import p_a
from arbiter.plans.q_decide import OUTCOME_DEFS, OUTCOMES_CTE
from arbiter.plans.registry import query
from arbiter.session import scratch_path
from arbiter.sources.tables import load
from arbiter.streaming import audit_stats as ST
from arbiter.streaming import decisions as SD
from arbiter.streaming import sinks as SK


@query("stream_decisions", "WITH " + OUTCOMES_CTE.strip() + """
SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, 'prediction' AS event_type, o_orderkey AS record_id,
       CAST(p >= 0.5 AS INTEGER) AS prediction, p AS probability, greatest(p, 1 - p) AS confidence,
       CASE WHEN greatest(p, 1 - p) > 0.8 THEN 'High' WHEN greatest(p, 1 - p) > 0.6 THEN 'Medium' ELSE 'Low' END
         AS confidence_level, 'model_a' AS model, 0.5 AS threshold,
       CASE WHEN p >= 0.5 THEN o.positive_action ELSE o.negative_action END AS recommended_action
FROM (SELECT *, 1.0 / (1.0 + exp(-((CAST(o_totalprice AS DOUBLE) - 250000.0) / 100000.0))) AS p FROM orders) s
LEFT JOIN outcomes o ON o.outcome = 'customer_churn'""", doubles=("probability", "confidence", "threshold"))
def stream_decisions(spark, sf):
    """STR1: orders streamed from the table folder -> score -> action -> audit parquet (append)."""
    outcomes = current_outcomes(outcome_log(spark, OUTCOME_DEFS))
    st = SD.decision_stream(spark, sf, "orders", lambda d: p_a(F.col("o_totalprice")), "o_orderkey",
                            "o_orderdate", "customer_churn", outcomes, "model_a")
    out, ck = scratch_path(spark, "stream-decisions"), scratch_path(spark, "stream-decisions-ckpt")
    SD.run_to_table(st, out, ck)
    res = spark.read.parquet(out)
    return res.select("ts", "event_type", "record_id", "prediction", "probability", "confidence",
                      "confidence_level", "model", "threshold", "recommended_action")


@query("stream_decisions_once", """
SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS record_id, CAST(p >= 0.5 AS INTEGER) AS prediction, p AS probability
FROM (SELECT *, 1.0 / (1.0 + exp(-((CAST(o_totalprice AS DOUBLE) - 250000.0) / 100000.0))) AS p FROM orders)""", doubles=("probability",))
def stream_decisions_once(spark, sf):
    """STR1/A2: the table streamed twice (a full replay) into the audit log; every record is there once."""
    outcomes = current_outcomes(outcome_log(spark, OUTCOME_DEFS))
    out = scratch_path(spark, "stream-once")
    parts = scratch_path(spark, "stream-once-source")
    orders = load(spark, sf, "orders")
    orders.write.parquet(f"{parts}/a/orders.parquet")
    for _ in range(2):  # the same records again, in other files
        st = SD.decision_stream(spark, f"{parts}/a", "orders", lambda d: p_a(F.col("o_totalprice")), "o_orderkey",
                                "o_orderdate", "customer_churn", outcomes, "model_a")
        SK.append_once(st, f"{out}/log", f"{out}/checkpoint")
        orders.write.mode("append").parquet(f"{parts}/a/orders.parquet")
    return SK.records(spark, f"{out}/log").select("ts", "record_id", "prediction", "probability")


_WINDOWS_SQL = """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
       CAST(count(*) AS BIGINT) AS n, avg(value) AS avg_value, sum(value) AS sum_value
FROM events GROUP BY ALL"""


def _windows(spark, sf) -> str:
    out = scratch_path(spark, "stream-windows")
    SK.append_windows(ST.event_stream(spark, sf, "events"), f"{out}/windows", f"{out}/checkpoint")
    return f"{out}/windows"


@query("stream_audit_stats", _WINDOWS_SQL, doubles=("avg_value", "sum_value"))
def stream_audit_stats(spark, sf):
    """STR2: daily event statistics per type with a 1-hour watermark: the closed windows and those still open."""
    out = _windows(spark, sf)
    return SK.closed_windows(spark, out).unionByName(SK.open_windows(spark, out))


@query("stream_audit_append", f"""
WITH w AS ({_WINDOWS_SQL})
SELECT *, window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS closed, CAST(0 AS BIGINT) AS n_late FROM w""", doubles=("avg_value", "sum_value"))
def stream_audit_append(spark, sf):
    """STR2 in append form: which windows are final, and the number of rows that came too late."""
    out = _windows(spark, sf)
    both = SK.closed_windows(spark, out).withColumn("closed", F.lit(True)).unionByName(SK.open_windows(spark, out).withColumn("closed", F.lit(False)))
    return attach(both, SK.late_rows(spark, out).agg(F.count(F.lit(1)).alias("n_late")))
