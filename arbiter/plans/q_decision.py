"""Threshold (T*) and cost (C*) queries over the ``scored`` frame."""

from __future__ import annotations

from arbiter.operators import cost, threshold
from arbiter.plans.frames import decided, decided_cte, scored, scored_cte
from arbiter.plans.registry import query
from arbiter.plans.util import with_ctes

RATES = ("precision", "recall", "f1", "specificity", "accuracy")
COSTS = ("fp_cost", "fn_cost", "total_fp_cost", "total_fn_cost", "total_cost",
         "average_cost_per_decision")

# per-threshold confusion counts, the cross-join form of the sweep
_COUNTS_SQL = """
th AS (SELECT i, i * CAST(0.01 AS DOUBLE) AS t FROM range(0, 101) r(i)),
cnt AS (
  SELECT s.model, th.i, th.t,
         CAST(sum(CASE WHEN s.p >= th.t AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN s.p >= th.t AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN NOT (s.p >= th.t) AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN NOT (s.p >= th.t) AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(count(*) AS BIGINT) AS n
  FROM scored s CROSS JOIN th
  GROUP BY s.model, th.i, th.t
),
rt AS (
  SELECT *,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity,
    CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END AS accuracy
  FROM cnt
),
rf AS (
  SELECT *, CASE WHEN precision + recall > 0
                 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM rt
),
sweep AS (
  SELECT model, round(t, 2) AS threshold, round(precision, 4) AS precision,
         round(recall, 4) AS recall, round(f1, 4) AS f1, round(specificity, 4) AS specificity,
         round(accuracy, 4) AS accuracy, tp, fp, tn, fn
  FROM rf
),
costcurve AS (
  SELECT model, round(t, 2) AS threshold, fp AS false_positives, fn AS false_negatives,
         tp AS true_positives, tn AS true_negatives, 100.0 AS fp_cost, 500.0 AS fn_cost,
         fp * 100.0 AS total_fp_cost, fn * 500.0 AS total_fn_cost,
         fp * 100.0 + fn * 500.0 AS total_cost,
         CASE WHEN n > 0 THEN (fp * 100.0 + fn * 500.0) / n ELSE 0.0 END AS average_cost_per_decision
  FROM cnt
)"""


@query("thr_sweep", with_ctes(scored_cte() + "," + _COUNTS_SQL, "SELECT * FROM sweep"),
       doubles=("threshold",) + RATES)
def thr_sweep(spark, sf):
    """Metrics at thresholds 0, 0.01, ..., 1 for each model."""
    return threshold.analyze_thresholds(scored(spark, sf))


def _at_sql(thresholds):
    vals = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in thresholds)
    return f"""
th AS (SELECT * FROM (VALUES {vals}) v(t)),
c AS (
  SELECT s.model, th.t AS threshold,
         CAST(sum(CASE WHEN s.p >= th.t AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN s.p >= th.t AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN NOT (s.p >= th.t) AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN NOT (s.p >= th.t) AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM scored s CROSS JOIN th GROUP BY s.model, th.t
),
r AS (
  SELECT *,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity,
    CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END AS accuracy
  FROM c
)"""


_AT_BODY = """SELECT model, threshold, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  specificity, accuracy, tp, fp, tn, fn FROM r"""


@query("thr_at", with_ctes(scored_cte() + "," + _at_sql([0.5]), _AT_BODY),
       doubles=("threshold",) + RATES)
def thr_at(spark, sf):
    """Unrounded metrics at threshold 0.5."""
    return threshold.metrics_at_threshold(scored(spark, sf), 0.5)


COMPARE_THRESHOLDS = (0.3, 0.35, 0.5, 0.7)


@query("thr_compare", with_ctes(scored_cte() + "," + _at_sql(COMPARE_THRESHOLDS), _AT_BODY),
       doubles=("threshold",) + RATES)
def thr_compare(spark, sf):
    """Metrics at a list of thresholds."""
    return threshold.compare_thresholds(scored(spark, sf), COMPARE_THRESHOLDS)


@query("thr_optimal", with_ctes(scored_cte() + "," + _COUNTS_SQL, """
SELECT model, metric, threshold, value FROM (
  SELECT model, 'f1' AS metric, threshold, f1 AS value,
         row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS rn
  FROM sweep) WHERE rn = 1"""), doubles=("threshold", "value"))
def thr_optimal(spark, sf):
    """Threshold with the best rounded F1 per model (first wins)."""
    return threshold.optimal_threshold(scored(spark, sf), "f1")


_CURVE_SQL = """
sc AS (
  SELECT model, p, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
  FROM scored WHERE p IS NOT NULL GROUP BY model, p
),
cum AS (
  SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS cum_pos,
            sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS cum_neg,
            lead(pos) OVER (PARTITION BY model ORDER BY p DESC) AS next_pos,
            lead(neg) OVER (PARTITION BY model ORDER BY p DESC) AS next_neg,
            row_number() OVER (PARTITION BY model ORDER BY p DESC) AS rn,
            sum(pos) OVER (PARTITION BY model) AS tot_pos,
            sum(neg) OVER (PARTITION BY model) AS tot_neg
  FROM sc
)"""


@query("thr_roc_curve", with_ctes(scored_cte() + "," + _CURVE_SQL, """
SELECT model, CAST('Infinity' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM cum WHERE rn = 1
UNION ALL
SELECT model, p AS threshold,
       CASE WHEN tot_neg > 0 THEN cum_neg / tot_neg END AS fpr,
       CASE WHEN tot_pos > 0 THEN cum_pos / tot_pos END AS tpr
FROM cum
WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"""),
       doubles=("threshold", "fpr", "tpr"))
def thr_roc_curve(spark, sf):
    """T4: ROC points (collinear points dropped) starting at +inf."""
    return threshold.roc_curve(scored(spark, sf))


@query("thr_pr_curve", with_ctes(scored_cte() + "," + _CURVE_SQL, """
SELECT model, p AS threshold,
       CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0.0 END AS precision,
       CASE WHEN tot_pos > 0 THEN cum_pos / tot_pos ELSE 1.0 END AS recall
FROM cum
UNION ALL
SELECT DISTINCT model, CAST(NULL AS DOUBLE) AS threshold, 1.0 AS precision, 0.0 AS recall FROM cum"""),
       doubles=("threshold", "precision", "recall"))
def thr_pr_curve(spark, sf):
    """T5: precision-recall points plus the terminal (1, 0) row."""
    return threshold.pr_curve(scored(spark, sf))


@query("eval_auc", with_ctes(scored_cte() + "," + _CURVE_SQL, """
SELECT model, CASE WHEN max(tot_pos) > 0 AND max(tot_neg) > 0
                   THEN sum(neg * (cum_pos - pos / 2.0)) / (max(tot_pos) * max(tot_neg)) END AS roc_auc
FROM cum GROUP BY model"""), doubles=("roc_auc",))
def eval_auc(spark, sf):
    """Exact binary ROC-AUC per model."""
    return threshold.roc_auc(scored(spark, sf))


@query("cost_threshold_curve", with_ctes(scored_cte() + "," + _COUNTS_SQL,
                                         "SELECT * FROM costcurve"),
       doubles=("threshold",) + COSTS)
def cost_threshold_curve(spark, sf):
    """C4: expected cost at every threshold."""
    return cost.threshold_vs_cost(scored(spark, sf))


@query("cost_optimal_threshold", with_ctes(scored_cte() + "," + _COUNTS_SQL, """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY total_cost ASC, threshold ASC) AS rn
  FROM costcurve) WHERE rn = 1"""), doubles=("threshold",) + COSTS)
def cost_optimal_threshold(spark, sf):
    """C5 (flagship): cheapest threshold per model, first minimum wins."""
    return cost.optimal_threshold(scored(spark, sf))


_EXPECTED_SQL = """
cm AS (
  SELECT model,
         CAST(sum(CASE WHEN pred = 1 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN pred = 1 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN pred = 0 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN pred = 0 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(count(*) AS BIGINT) AS n
  FROM decided GROUP BY model
),
ec AS (
  SELECT model, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
         tn AS true_negatives, 100.0 AS fp_cost, 500.0 AS fn_cost,
         fp * 100.0 AS total_fp_cost, fn * 500.0 AS total_fn_cost,
         fp * 100.0 + fn * 500.0 AS total_cost,
         CASE WHEN n > 0 THEN (fp * 100.0 + fn * 500.0) / n ELSE 0.0 END AS average_cost_per_decision
  FROM cm
)"""


@query("cost_expected", with_ctes(decided_cte() + "," + _EXPECTED_SQL, "SELECT * FROM ec"),
       doubles=COSTS)
def cost_expected(spark, sf):
    """Expected cost of predictions at threshold 0.5."""
    return cost.expected_cost(decided(spark, sf))


@query("cost_compare_models", with_ctes(decided_cte() + "," + _EXPECTED_SQL, """
SELECT *, CAST(row_number() OVER (ORDER BY total_cost ASC, model ASC) AS INTEGER) AS cost_rank FROM ec"""),
       doubles=COSTS)
def cost_compare_models(spark, sf):
    """Models ranked by total cost."""
    return cost.compare_model_costs(decided(spark, sf))


@query("cost_optimal_model", with_ctes(decided_cte() + "," + _EXPECTED_SQL, """
SELECT * FROM ec ORDER BY total_cost ASC, model ASC LIMIT 1"""), doubles=COSTS)
def cost_optimal_model(spark, sf):
    """The cheapest model."""
    return cost.optimal_model(decided(spark, sf))


@query("cost_sensitivity", with_ctes(decided_cte() + "," + _EXPECTED_SQL + """,
g AS (SELECT a.v AS fpc, b.v AS fnc
      FROM (SELECT 10.0 + i * (990.0 / 4) AS v FROM range(0, 5) r(i)) a,
           (SELECT 10.0 + i * (990.0 / 4) AS v FROM range(0, 5) r(i)) b)""", """
SELECT model, false_positives, false_negatives, true_positives, true_negatives,
       g.fpc AS fp_cost, g.fnc AS fn_cost, false_positives * g.fpc AS total_fp_cost,
       false_negatives * g.fnc AS total_fn_cost,
       false_positives * g.fpc + false_negatives * g.fnc AS total_cost,
       (false_positives * g.fpc + false_negatives * g.fnc)
         / (false_positives + false_negatives + true_positives + true_negatives) AS average_cost_per_decision
FROM ec CROSS JOIN g"""), doubles=COSTS)
def cost_sensitivity(spark, sf):
    """Total cost over a 5 x 5 grid of unit costs."""
    return cost.cost_sensitivity(decided(spark, sf))


@query("cost_benefit", with_ctes(decided_cte() + "," + _EXPECTED_SQL, """
SELECT model, true_positives * 1000.0 AS total_benefit, total_cost,
       true_positives * 1000.0 - total_cost AS net_benefit,
       CASE WHEN total_cost > 0 THEN (true_positives * 1000.0 - total_cost) / total_cost * 100
            ELSE 0.0 END AS roi
FROM ec"""), doubles=("total_benefit", "total_cost", "net_benefit", "roi"))
def cost_benefit(spark, sf):
    """Net benefit and ROI at 1000 per true positive."""
    return cost.cost_benefit(decided(spark, sf))
