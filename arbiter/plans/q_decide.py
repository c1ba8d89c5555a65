"""Decision mapping (D*), audit log (A*) and file source/sink (S*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import audit as A
from arbiter.operators import audit_states as AS
from arbiter.operators import cost
from arbiter.operators import decide as D
from arbiter.operators.common import attach
from arbiter.plans.frames import decided, decided_cte, scored
from arbiter.plans.q_decision import _COUNTS_SQL
from arbiter.plans.registry import query
from arbiter.plans.util import with_ctes
from arbiter.session import scratch_path
from arbiter.sources import files, synth
from arbiter.sources.tables import load

# fixed values: the outcome definitions (an upsert log; the latest version wins)
OUTCOME_DEFS = [
    ("customer_churn", "Customer will churn", "Customer will stay", "Send retention offer",
     "Standard engagement", "Churn risk", 1),
    ("customer_churn", "Customer will churn", "Customer will stay", "Send retention offer",
     "Monitor account", "Churn risk, revised", 2),
    ("fraud_detection", "Fraudulent", "Legitimate", "Flag for review", "Approve automatically",
     "Fraud screening", 1),
    ("loan_approval", "Approve", "Reject", "Approve", "Suggest alternatives", "Loan decision", 1),
]


def _sql_str(v):
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


OUTCOMES_CTE = """
outcome_log AS (SELECT * FROM (VALUES """ + ", ".join(
    "(" + ", ".join(_sql_str(v) for v in d[:6]) + f", {d[6]})" for d in OUTCOME_DEFS) + """)
  v(outcome, positive_label, negative_label, positive_action, negative_action, description, version)),
outcomes AS (SELECT * EXCLUDE (version, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY version DESC) AS rn FROM outcome_log) WHERE rn = 1)"""

DECISIONS_CTE = decided_cte() + "," + OUTCOMES_CTE + """,
decisions AS (
  SELECT id, model, y, p, pred, status, ts, greatest(p, 1 - p) AS confidence,
         CASE WHEN model = 'model_a' THEN 'customer_churn' WHEN status = 'O' THEN 'credit_review'
              ELSE 'fraud_detection' END AS outcome FROM decided),
acts AS (
  SELECT d.id, d.model, d.outcome, d.pred AS prediction,
         CASE WHEN o.outcome IS NOT NULL THEN CASE WHEN d.pred = 1 THEN o.positive_label ELSE o.negative_label END END AS label,
         CASE WHEN o.outcome IS NOT NULL THEN CASE WHEN d.pred = 1 THEN o.positive_action ELSE o.negative_action END END AS action,
         d.confidence, o.description,
         CASE WHEN o.outcome IS NULL THEN 'Outcome ''' || d.outcome || ''' not defined' END AS error
  FROM decisions d LEFT JOIN outcomes o ON d.outcome = o.outcome)"""


def outcomes(spark):
    return D.current_outcomes(D.outcome_log(spark, OUTCOME_DEFS))


def decisions(spark, sf):
    d = decided(spark, sf, extra=("status", "ts"))
    oc = (F.when(F.col("model") == "model_a", "customer_churn").when(F.col("status") == "O", "credit_review")
          .otherwise("fraud_detection"))
    return d.withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p"))).withColumn("outcome", oc)


def acts(spark, sf):
    a = D.actions(decisions(spark, sf), outcomes(spark))
    return a.select("id", "model", "outcome", F.col("pred").alias("prediction"), "label", "action",
                    "confidence", "description", "error")


@query("decide_outcomes", with_ctes(DECISIONS_CTE, """
SELECT o.*, CAST(coalesce(n.n, 0) AS BIGINT) AS n_predictions FROM outcomes o
LEFT JOIN (SELECT outcome, count(*) AS n FROM decisions GROUP BY outcome) n USING (outcome)"""))
def decide_outcomes(spark, sf):
    """D-1: current outcome definitions with the number of predictions mapped to each."""
    n = decisions(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return (outcomes(spark).join(n, "outcome", "left")
            .withColumn("n_predictions", F.coalesce("n", F.lit(0)).cast("long")).drop("n"))


@query("decide_actions", with_ctes(DECISIONS_CTE, "SELECT * FROM acts"), doubles=("confidence",))
def decide_actions(spark, sf):
    """D-2: action per prediction via a broadcast outcome lookup; undefined -> error."""
    return acts(spark, sf)


@query("decide_matrix", with_ctes(DECISIONS_CTE, """
SELECT m.*, CAST(coalesce(n.n, 0) AS BIGINT) AS n_predictions FROM (
  SELECT outcome, description, 1 AS prediction, positive_label AS label, positive_action AS action FROM outcomes
  UNION ALL
  SELECT outcome, description, 0, negative_label, negative_action FROM outcomes) m
LEFT JOIN (SELECT outcome, pred AS prediction, count(*) AS n FROM decisions GROUP BY ALL) n
  USING (outcome, prediction)"""))
def decide_matrix(spark, sf):
    """D-3: decision matrix (two rows per outcome) with prediction counts."""
    n = decisions(spark, sf).groupBy("outcome", F.col("pred").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    m = D.decision_matrix(outcomes(spark))
    return (m.join(n, ["outcome", "prediction"], "left")
            .withColumn("n_predictions", F.coalesce("n", F.lit(0)).cast("long")).drop("n"))


def _templates_sql():
    rows = [(d, s, i, a) for d, v in D.DOMAIN_TEMPLATES.items() for s in ("positive", "negative")
            for i, a in enumerate(v[s])]
    return "tpl AS (SELECT * FROM (VALUES " + ", ".join(
        f"({_sql_str(d)}, {_sql_str(s)}, {i}, {_sql_str(a)})" for d, s, i, a in rows) + \
        ") v(domain, sign, ordinal, action))"


@query("decide_templates", with_ctes(DECISIONS_CTE + "," + _templates_sql(), """
SELECT t.domain, t.sign, t.ordinal, t.action, CAST(coalesce(u.n, 0) AS BIGINT) AS times_used
FROM tpl t LEFT JOIN (
  SELECT action, CASE WHEN prediction = 1 THEN 'positive' ELSE 'negative' END AS sign, count(*) AS n
  FROM acts WHERE action IS NOT NULL GROUP BY ALL) u USING (action, sign)"""))
def decide_templates(spark, sf):
    """D-4: domain action templates with how often each action was recommended."""
    u = (acts(spark, sf).where(F.col("action").isNotNull())
         .groupBy("action", F.when(F.col("prediction") == 1, "positive").otherwise("negative").alias("sign"))
         .agg(F.count(F.lit(1)).alias("n")))
    t = D.templates(spark)
    return (t.join(u, ["action", "sign"], "left")
            .select("domain", "sign", "ordinal", "action", F.coalesce("n", F.lit(0)).cast("long").alias("times_used")))


# ---------------------------------------------------------------- audit log

def audit_log(spark, sf):
    """Prediction, threshold-change and action-taken events derived from the data."""
    # the action lookup keeps every input column (p, status, ts): no join back needed
    dec = decisions(spark, sf)
    pj = D.actions(dec, outcomes(spark)).withColumnRenamed("pred", "prediction")
    preds = A.prediction_events(pj, ts="ts", key="id", pred="prediction", prob="p",
                                confidence="confidence", model="model", threshold=0.5, action="action",
                                feature_cols=("p",), metadata={"source": "orders"})
    opt = cost.optimal_threshold(scored(spark, sf)).select("model", F.col("threshold").alias("new"))
    last = scored(spark, sf, extra=("ts",)).groupBy("model").agg(F.max("ts").alias("ts"))
    th = A.threshold_events(opt.join(last, "model").withColumn("old", F.lit(0.5)), "ts", "model", "old", "new",
                            reason="cost optimum", changed_by="cost_analyzer")
    done = pj.where((F.col("prediction") == 1) & (F.col("status") == "F")).select(
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), "id", "action")
    ac = A.action_events(done, "ts", "id", "action", result="done", by="system")
    # a lazy union: a filter on the (literal) event type leaves one branch
    return preds.unionByName(th).unionByName(ac)


AUDIT_CTE = DECISIONS_CTE + "," + _COUNTS_SQL + """,
opt AS (SELECT model, threshold AS new FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY total_cost ASC, threshold ASC) AS rn FROM costcurve)
  WHERE rn = 1),
pj AS (SELECT a.*, d.p, d.status, d.ts FROM acts a JOIN decisions d USING (id, model)),
audit AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts, 'prediction' AS event_type, CAST(id AS BIGINT) AS record_id,
         CAST(prediction AS INTEGER) AS prediction, p AS probability, confidence,
         CASE WHEN confidence > 0.8 THEN 'High' WHEN confidence > 0.6 THEN 'Medium' ELSE 'Low' END AS confidence_level,
         model, 0.5 AS threshold, action AS recommended_action,
         CAST(to_json(MAP(['p'], [printf('%.2f', p)])) AS VARCHAR) AS features,
         CAST(to_json(MAP(['source'], ['orders'])) AS VARCHAR) AS metadata,
         CAST(NULL AS DOUBLE) AS old_threshold, CAST(NULL AS DOUBLE) AS new_threshold,
         CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS changed_by,
         CAST(NULL AS BIGINT) AS prediction_id, CAST(NULL AS VARCHAR) AS action,
         CAST(NULL AS VARCHAR) AS action_result, CAST(NULL AS VARCHAR) AS actioned_by
  FROM pj
  UNION ALL
  SELECT CAST(l.ts AS TIMESTAMP), 'threshold_change', NULL, NULL, NULL, NULL, NULL, o.model, NULL, NULL, NULL, NULL,
         0.5, o.new, 'cost optimum', 'cost_analyzer', NULL, NULL, NULL, NULL
  FROM opt o JOIN (SELECT model, max(ts) AS ts FROM scored GROUP BY model) l USING (model)
  UNION ALL
  SELECT CAST(ts + INTERVAL 1 DAY AS TIMESTAMP), 'action_taken', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         NULL, NULL, NULL, NULL, NULL, id, action, 'done', 'system'
  FROM pj WHERE prediction = 1 AND status = 'F')"""


def _flat(df):
    return files.flatten_for_csv(df)


@query("audit_log_predictions", with_ctes(AUDIT_CTE, "SELECT ts, event_type, record_id, prediction, probability, confidence, confidence_level, model, threshold, recommended_action, features, metadata FROM audit WHERE event_type = 'prediction'"),
       doubles=("probability", "confidence", "threshold"))
def audit_log_predictions(spark, sf):
    """A1: prediction records (nested fields shown as JSON text)."""
    return _flat(audit_log(spark, sf).where("event_type = 'prediction'")).selectExpr(*"ts, event_type, record_id, prediction, probability, confidence, confidence_level, model, threshold, recommended_action, features, metadata".split(", "))


@query("audit_threshold_changes", with_ctes(AUDIT_CTE, "SELECT ts, event_type, model, old_threshold, new_threshold, reason, changed_by FROM audit WHERE event_type = 'threshold_change'"),
       doubles=("old_threshold", "new_threshold"))
def audit_threshold_changes(spark, sf):
    """A3: threshold-change records (old 0.5 -> cost-optimal)."""
    return audit_log(spark, sf).where("event_type = 'threshold_change'").selectExpr(*"ts, event_type, model, old_threshold, new_threshold, reason, changed_by".split(", "))


@query("audit_log_batch", with_ctes(AUDIT_CTE, """
SELECT record_id, prediction, confidence_level, batch_id,
       CAST(row_number() OVER (PARTITION BY batch_id ORDER BY record_id, model) - 1 AS VARCHAR) AS batch_index
FROM (SELECT *, strftime(ts, '%Y-%m') AS batch_id FROM audit WHERE event_type = 'prediction')"""))
def audit_log_batch(spark, sf):
    """A2: prediction records logged in monthly batches with batch id and index."""
    pj = D.actions(decisions(spark, sf), outcomes(spark)).withColumnRenamed("pred", "prediction")
    ev = A.batch_events(pj, F.date_format("ts", "yyyy-MM"), key="id", tie="model", ts="ts", pred="prediction", prob="p",
                        confidence="confidence", model="model", action="action")
    return ev.select("record_id", "prediction", "confidence_level",
                     F.col("metadata")["batch_id"].alias("batch_id"),
                     F.col("metadata")["batch_index"].alias("batch_index"))


@query("audit_trail", with_ctes(AUDIT_CTE, """
SELECT coalesce(record_id, prediction_id) AS trail_id, ts, event_type,
       coalesce(recommended_action, action) AS action_text, coalesce(confidence_level, '') AS confidence_level
FROM audit WHERE coalesce(record_id, prediction_id) IN (SELECT prediction_id FROM audit WHERE event_type = 'action_taken')"""))
def audit_trail(spark, sf):
    """A4/A5: full trail (prediction + action) of every prediction that was acted on."""
    log = audit_log(spark, sf)
    ids = log.where("event_type = 'action_taken'").select(F.col("prediction_id").alias("id"))
    t = A.trail(log, ids)
    return t.select("trail_id", "ts", "event_type", F.coalesce("recommended_action", "action").alias("action_text"),
                    F.coalesce("confidence_level", F.lit("")).alias("confidence_level"))


_STATS_SQL = """
st AS (SELECT count(*) AS all_records,
         count(confidence) FILTER (WHERE event_type = 'prediction') AS total_predictions,
         avg(confidence) FILTER (WHERE event_type = 'prediction') AS avg_confidence,
         min(confidence) FILTER (WHERE event_type = 'prediction') AS min_confidence,
         max(confidence) FILTER (WHERE event_type = 'prediction') AS max_confidence,
         count(*) FILTER (WHERE event_type = 'prediction' AND confidence > 0.8) AS high_confidence_count,
         count(*) FILTER (WHERE event_type = 'prediction' AND confidence >= 0.6 AND confidence <= 0.8)
           AS medium_confidence_count,
         count(*) FILTER (WHERE event_type = 'prediction' AND confidence < 0.6) AS low_confidence_count,
         count(*) FILTER (WHERE event_type = 'prediction' AND prediction = 1) AS positive_predictions,
         count(*) FILTER (WHERE event_type = 'prediction' AND prediction = 0) AS negative_predictions,
         min(ts) FILTER (WHERE event_type = 'prediction') AS first_record_time,
         max(ts) FILTER (WHERE event_type = 'prediction') AS last_record_time
       FROM audit),
st2 AS (SELECT CAST(CASE WHEN total_predictions > 0 THEN all_records ELSE 0 END AS BIGINT) AS total_records,
               * EXCLUDE (all_records) FROM st)"""


@query("audit_statistics", with_ctes(AUDIT_CTE + "," + _STATS_SQL, "SELECT * FROM st2"),
       doubles=("avg_confidence", "min_confidence", "max_confidence"))
def audit_statistics(spark, sf):
    """Audit statistics."""
    return A.statistics(audit_log(spark, sf))


@query("audit_statistics_incremental", with_ctes(AUDIT_CTE + "," + _STATS_SQL, "SELECT * FROM st2"),
       doubles=("avg_confidence", "min_confidence", "max_confidence"))
def audit_statistics_incremental(spark, sf):
    """A6 from partial states: three appends, one of them twice, merged on read."""
    return AS.statistics(AS.merge(_states(spark, sf)))


def _states(spark, sf):
    log, path = audit_log(spark, sf), scratch_path(spark, "audit-states")
    part = F.pmod(F.xxhash64("ts", "event_type", "record_id"), F.lit(3))
    for i in (0, 1, 1, 2):
        AS.append(log.where(part == i), path, i)
    return AS.load(spark, path)


_FRACTIONS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("audit_quantiles_sketch", with_ctes(AUDIT_CTE, "SELECT f.fraction, CAST(count(confidence) AS BIGINT) AS n, true AS within_1_percent FROM audit, (VALUES "
       + ", ".join(f"({f}::DOUBLE)" for f in _FRACTIONS) + ") f(fraction) WHERE event_type = 'prediction' GROUP BY f.fraction"), doubles=("fraction",))
def audit_quantiles_sketch(spark, sf):
    """Confidence quantiles from stored sketches: the ranks of the estimates are within 1 % of those asked for."""
    q = AS.quantiles(AS.merge(_states(spark, sf)), _FRACTIONS)
    c = audit_log(spark, sf).where("event_type = 'prediction'").select("confidence")
    asked = q.agg(F.collect_list(F.struct("fraction", F.col("confidence").alias("_q"))).alias("_asked"))  # five pairs
    ranks = attach(c, asked).select("confidence", F.inline("_asked"))
    r = ranks.groupBy("fraction").agg(F.count("confidence").alias("n"), F.avg((F.col("confidence") < F.col("_q")).cast("double")).alias("below"),
                                      F.avg((F.col("confidence") <= F.col("_q")).cast("double")).alias("upto"))
    near = (F.col("below") <= F.col("fraction") + 0.01) & (F.col("upto") >= F.col("fraction") - 0.01)
    return r.select("fraction", "n", near.alias("within_1_percent"))


@query("audit_report", with_ctes(AUDIT_CTE + "," + _STATS_SQL, """
SELECT CASE WHEN total_records = 0 THEN 'No audit records found.' ELSE
  '=== AUDIT LOG REPORT ===' || chr(10) || chr(10) || 'STATISTICS:' || chr(10) ||
  '- Total Records: ' || total_records || chr(10) ||
  '- Total Predictions: ' || total_predictions || chr(10) ||
  '- Avg Confidence: ' || printf('%.3f', avg_confidence) || chr(10) ||
  '- High Confidence: ' || high_confidence_count || ' (' || printf('%.1f', high_confidence_count / total_predictions * 100) || '%)' || chr(10) ||
  '- Medium Confidence: ' || medium_confidence_count || ' (' || printf('%.1f', medium_confidence_count / total_predictions * 100) || '%)' || chr(10) ||
  '- Low Confidence: ' || low_confidence_count || ' (' || printf('%.1f', low_confidence_count / total_predictions * 100) || '%)' || chr(10) ||
  '- Positive Predictions: ' || positive_predictions || chr(10) ||
  '- Negative Predictions: ' || negative_predictions || chr(10) ||
  '- Time Range: ' || strftime(first_record_time, '%Y-%m-%dT%H:%M:%S') || ' to ' ||
  strftime(last_record_time, '%Y-%m-%dT%H:%M:%S') || chr(10) END AS report
FROM st2"""))
def audit_report(spark, sf):
    """Audit report text."""
    return A.report(A.statistics(audit_log(spark, sf)))


@query("audit_recent", with_ctes(AUDIT_CTE, """
SELECT substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 19) AS timestamp, model, prediction,
       printf('%.3f', confidence) AS confidence, threshold, substr(coalesce(recommended_action, ''), 1, 50) AS action
FROM (SELECT * FROM audit ORDER BY ts DESC, event_type ASC, coalesce(record_id, prediction_id) DESC, coalesce(model, '') ASC LIMIT 20)
WHERE event_type = 'prediction'"""), doubles=("threshold",))
def audit_recent(spark, sf):
    """The 20 latest records, prediction rows shown (the limit is the feature)."""
    return A.recent(audit_log(spark, sf))


# ---------------------------------------------------------------- file round trips

_JSON_AGG = """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, sum(confidence) AS sum_confidence,
       CAST(count(features) AS BIGINT) AS n_features, min(ts) AS first_ts, max(ts) AS last_ts,
       sum(new_threshold) AS sum_new_threshold
FROM {src} GROUP BY event_type"""


@query("audit_json_roundtrip", with_ctes(AUDIT_CTE, _JSON_AGG.format(src="audit")),
       doubles=("sum_confidence", "sum_new_threshold"))
def audit_json_roundtrip(spark, sf):
    """Audit log written as JSON and loaded back with the declared schema."""
    back = files.roundtrip_json(spark, audit_log(spark, sf), A.AUDIT_SCHEMA, "audit-json")
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("sum_confidence"),
        F.count("features").alias("n_features"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum("new_threshold").alias("sum_new_threshold"))


@query("audit_flat_csv", with_ctes(AUDIT_CTE, """
SELECT event_type, coalesce(record_id, prediction_id, -1) AS key, coalesce(CAST(features AS VARCHAR), '') AS features,
       coalesce(CAST(metadata AS VARCHAR), '') AS metadata FROM audit"""))
def audit_flat_csv(spark, sf):
    """Audit log flattened (nested fields as JSON text) to CSV and read back."""
    flat = files.flatten_for_csv(audit_log(spark, sf))
    back = files.roundtrip_csv(spark, flat, "audit-csv", schema=flat.schema)
    return back.select("event_type", F.coalesce("record_id", "prediction_id", F.lit(-1)).alias("key"),
                       F.coalesce("features", F.lit("")).alias("features"),
                       F.coalesce("metadata", F.lit("")).alias("metadata"))


@query("outcome_roundtrip", with_ctes(DECISIONS_CTE, """
SELECT o.*, CAST(coalesce(n.n, 0) AS BIGINT) AS n_predictions FROM outcomes o
LEFT JOIN (SELECT outcome, count(*) AS n FROM decisions GROUP BY outcome) n USING (outcome)"""))
def outcome_roundtrip(spark, sf):
    """Outcome mappings exported to JSON, imported, and applied to the data."""
    from arbiter.operators.decide import OUTCOME_SCHEMA
    schema = OUTCOME_SCHEMA
    log = D.outcome_log(spark, OUTCOME_DEFS)
    back = files.roundtrip_json(spark, log, schema, "outcomes-json")
    n = decisions(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return (D.current_outcomes(back).join(n, "outcome", "left")
            .withColumn("n_predictions", F.coalesce("n", F.lit(0)).cast("long")).drop("n"))


@query("audit_typed_payload", """
SELECT o_orderkey AS record_id, 'v' || CAST(o_orderkey % 2 + 1 AS VARCHAR) AS written,
       CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_totalprice AS DOUBLE) * 2 END AS twice_price,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(CAST(o_totalprice AS DOUBLE)) AS BIGINT) END AS old_price, o_custkey AS customer FROM orders""", doubles=("twice_price",))
def audit_typed_payload(spark, sf):
    """A1: numbers of a payload survive the JSON round trip as numbers; records of an older table with text maps are read beside them."""
    o = load(spark, sf, "orders").withColumn("price", F.col("o_totalprice").cast("double"))
    base = [F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("prediction").alias("event_type"), F.col("o_orderkey").alias("record_id")]
    odd = F.col("o_orderkey") % 2 == 1
    new = o.where(odd).select(*base, A.payload(F.col("price"), F.col("o_custkey").alias("customer")).alias("features"))
    old = o.where(~odd).select(*base, F.create_map(F.lit("price"), F.floor("price").cast("string"), F.lit("customer"), F.col("o_custkey").cast("string")).alias("features"),
                               F.lit("v1").alias("source_version"))
    paths = [scratch_path(spark, "audit-typed"), scratch_path(spark, "audit-old")]
    A.append_typed(new, paths[0])
    old.write.parquet(paths[1])
    log = A.load_typed(spark, paths).withColumn("text", F.to_json("features"))
    back = F.parse_json("text")
    return log.select("record_id", F.coalesce(F.try_variant_get("extra", "$.source_version", "string"), F.lit("v2")).alias("written"),
                      (F.when(F.schema_of_variant(back).contains("price: STRING"), None).otherwise(F.try_variant_get(back, "$.price", "double")) * 2).alias("twice_price"),
                      F.when(F.schema_of_variant(back).contains("price: STRING"), F.try_variant_get(back, "$.price", "string").cast("long")).alias("old_price"),
                      F.try_variant_get(back, "$.customer", "string").cast("long").alias("customer"))


@query("src_csv_rescue", """
SELECT CAST(count(*) FILTER (WHERE o_orderkey % 10 > 1) AS BIGINT) AS n_rows, CAST(sum(o_custkey) FILTER (WHERE o_orderkey % 10 > 1) AS BIGINT) AS sum_customers,
       CAST(count(*) FILTER (WHERE o_orderkey % 10 = 0) AS BIGINT) AS n_short, CAST(count(*) FILTER (WHERE o_orderkey % 10 = 1) AS BIGINT) AS n_not_a_number FROM orders""")
def src_csv_rescue(spark, sf):
    """Broken lines of a CSV are kept and counted, not read as rows of nulls."""
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    line = F.when(k % 10 == 0, F.concat_ws(",", k.cast("string"), F.lit("short"))).when(k % 10 == 1, F.concat_ws(",", k.cast("string"), F.lit("many"), "o_orderstatus")) \
        .otherwise(F.concat_ws(",", k.cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus"))
    path = scratch_path(spark, "csv-broken")
    o.select(line.alias("value")).write.text(path)
    rows, broken = files.read_csv_checked(spark, path, "key long, customer long, status string", header=False)
    good = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("customer").alias("sum_customers"))
    bad = broken.agg(F.count(F.when(F.col("_broken").endswith(",short"), 1)).alias("n_short"), F.count(F.when(F.col("_broken").contains(",many,"), 1)).alias("n_not_a_number"))
    return attach(good, bad)


@query("src_csv_roundtrip", """
SELECT p_brand, CAST(count(*) AS BIGINT) AS n, sum(p_retailprice) AS sum_price, CAST(sum(p_size) AS BIGINT) AS sum_size,
       min(p_name) AS min_name
FROM part GROUP BY p_brand""", doubles=("sum_price",))
def src_csv_roundtrip(spark, sf):
    """``part`` written as CSV with a header, read back with inferred types."""
    back = files.roundtrip_csv(spark, load(spark, sf, "part"), "part-csv")
    return back.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("sum_price"),
                                       F.sum("p_size").cast("long").alias("sum_size"),
                                       F.min("p_name").alias("min_name"))


def _synth_sql():
    def u(col):
        return f"(CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || ':{col}'), 1, 8)) AS BIGINT) / 4294967296.0)"

    def rng(col, lo, hi):
        return f"CAST({lo} + floor({u(col)} * {hi - lo}) AS INTEGER)"

    def choice(col, vals):
        return f"[{', '.join(_sql_str(v) for v in vals)}][CAST(floor({u(col)} * {len(vals)}) + 1 AS INTEGER)]"
    return f"""
base AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, -50.0 * ln(1.0 - {u('order_value')}) + 10.0 AS order_value,
         {rng('customer_age', 18, 75)} AS customer_age, {rng('days_since_signup', 1, 365)} AS days_since_signup,
         {rng('num_previous_orders', 0, 50)} AS num_previous_orders,
         {choice('customer_region', synth.REGIONS)} AS customer_region,
         {choice('product_category', synth.CATEGORIES)} AS product_category,
         {choice('payment_method', synth.PAYMENTS)} AS payment_method,
         -10.0 * ln(1.0 - {u('time_on_site_minutes')}) + 1.0 AS time_on_site_minutes,
         {rng('items_in_cart', 1, 10)} AS items_in_cart,
         CAST({u('discount_applied')} >= 0.7 AS INTEGER) AS discount_applied, {u('churn')} AS uc
  FROM customer)"""


@query("src_synth_churn", with_ctes(_synth_sql(), """
SELECT * EXCLUDE (uc), CAST(uc < least(greatest(0.3 - 0.01 * (order_value - 10) / 100
       - 0.02 * num_previous_orders / 10 - 0.001 * customer_age / 10 + 0.05 * (1 - discount_applied), 0.0), 1.0)
       AS INTEGER) AS churn
FROM base"""), doubles=("order_value", "time_on_site_minutes"))
def src_synth_churn(spark, sf):
    """S3: synthetic churn table, one row per customer."""
    return synth.churn_table(load(spark, sf, "customer"), "c_custkey")


@query("audit_batch_nulls", """
SELECT b AS batch_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - 1 AS BIGINT) AS last_index
FROM (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y') END AS b FROM orders) GROUP BY b""")
def audit_batch_nulls(spark, sf):
    """A2 on records without a time or key: none is lost, each batch is numbered without gaps."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    r = o.select(F.when(k % 3 != 0, k).alias("id"), F.when(k % 4 != 0, F.col("o_orderdate")).alias("ts"), F.lit(1).alias("pred"),
                 F.lit(0.9).alias("p"), F.lit(0.9).alias("confidence"), F.lit("m").alias("model"), F.lit("a").alias("action"), k.alias("line"))
    ev = A.batch_events(r, F.date_format("ts", "yyyy"), tie="line")
    m = F.col("metadata")
    return ev.groupBy(m["batch_id"].alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max(m["batch_index"].cast("long")).alias("last_index"))
