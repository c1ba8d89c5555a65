"""Evaluation (E*), confidence (U*, P10) and subgroup (R4) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import confidence as U
from arbiter.operators import evaluate as E
from arbiter.plans.frames import (PROBA3_CTE, REGRESSED_CTE, decided, decided_cte, proba3,
                                  regressed)
from arbiter.plans.registry import query
from arbiter.plans.util import with_ctes

_CLS_SQL = """
cm AS (SELECT model, y AS actual, pred AS predicted, CAST(count(*) AS BIGINT) AS cnt
       FROM decided GROUP BY model, y, pred),
pc AS (
  SELECT model, cls, sum(support) AS support, sum(predicted_n) AS predicted_n, sum(tp) AS tp FROM (
    SELECT model, actual AS cls, cnt AS support, 0 AS predicted_n,
           CASE WHEN actual = predicted THEN cnt ELSE 0 END AS tp FROM cm
    UNION ALL
    SELECT model, predicted AS cls, 0 AS support, cnt AS predicted_n, 0 AS tp FROM cm)
  GROUP BY model, cls),
pm AS (SELECT *, CASE WHEN predicted_n > 0 THEN tp / predicted_n ELSE 0.0 END AS prec,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM pc),
clsm AS (
  SELECT model, sum(tp) / sum(support) AS accuracy,
         sum(prec * support) / sum(support) AS precision,
         sum(rec * support) / sum(support) AS recall,
         sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * support)
           / sum(support) AS f1
  FROM pm GROUP BY model),
sc AS (
  SELECT model, p, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
  FROM decided WHERE p IS NOT NULL GROUP BY model, p),
cum AS (
  SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS cum_pos,
            sum(pos) OVER (PARTITION BY model) AS tot_pos,
            sum(neg) OVER (PARTITION BY model) AS tot_neg FROM sc),
auc AS (
  SELECT model, CASE WHEN max(tot_pos) > 0 AND max(tot_neg) > 0
                     THEN sum(neg * (cum_pos - pos / 2.0)) / (max(tot_pos) * max(tot_neg)) END AS roc_auc
  FROM cum GROUP BY model),
allm AS (SELECT c.*, a.roc_auc FROM clsm c LEFT JOIN auc a USING (model))"""

METRICS = ("accuracy", "precision", "recall", "f1")


@query("eval_classification", with_ctes(decided_cte() + "," + _CLS_SQL, "SELECT * FROM clsm"),
       doubles=METRICS)
def eval_classification(spark, sf):
    """Accuracy and weighted precision/recall/F1 per model at 0.5."""
    return E.classification_metrics(decided(spark, sf))


@query("eval_all_models", with_ctes(decided_cte() + "," + _CLS_SQL, "SELECT * FROM allm"),
       doubles=METRICS + ("roc_auc",))
def eval_all_models(spark, sf):
    """Every model's classification metrics and ROC-AUC in one job."""
    return E.evaluate_models(decided(spark, sf))


@query("eval_best_model", with_ctes(decided_cte() + "," + _CLS_SQL, """
SELECT model, 'f1' AS metric, coalesce(f1, 0.0) AS value FROM allm
ORDER BY coalesce(f1, 0.0) DESC, model ASC LIMIT 1"""), doubles=("value",))
def eval_best_model(spark, sf):
    """Best model by F1."""
    return E.best_model(E.evaluate_models(decided(spark, sf)))


@query("eval_model_comparison", with_ctes(decided_cte() + "," + _CLS_SQL, """
SELECT array_to_string(list_transform(string_split(replace(model, '_', ' '), ' '),
                                      lambda w: upper(w[1]) || lower(w[2:])), ' ') AS model_name,
       allm.*, CASE WHEN model = (SELECT model FROM allm ORDER BY coalesce(f1, 0.0) DESC, model ASC LIMIT 1)
                    THEN 'RECOMMENDED' ELSE '' END AS status
FROM allm"""), doubles=METRICS + ("roc_auc",))
def eval_model_comparison(spark, sf):
    """Comparison table with the RECOMMENDED model flagged."""
    return E.model_comparison(E.evaluate_models(decided(spark, sf)))


@query("eval_confusion", with_ctes(decided_cte(), """
SELECT model, y AS actual, pred AS predicted, CAST(count(*) AS BIGINT) AS count
FROM decided GROUP BY model, y, pred"""))
def eval_confusion(spark, sf):
    """Confusion matrix cells per model."""
    return E.confusion(decided(spark, sf))


@query("eval_confusion_dense", with_ctes(decided_cte(), """
SELECT g.model, g.actual, g.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT m.model, a.v AS actual, b.v AS predicted FROM (SELECT DISTINCT model FROM decided) m, (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v)) g
LEFT JOIN (SELECT model, y, pred, count(*) AS n FROM (SELECT model, y, CASE WHEN model = 'model_b' THEN 0 ELSE pred END AS pred FROM decided)
           GROUP BY ALL) c ON c.model = g.model AND c.y = g.actual AND c.pred = g.predicted"""))
def eval_confusion_dense(spark, sf):
    """All cells per model, with zeros where one model never predicts the positive class."""
    d = decided(spark, sf).withColumn("pred", F.when(F.col("model") == "model_b", F.lit(0)).otherwise(F.col("pred")))
    return E.confusion_dense(d)


@query("eval_regression", with_ctes(REGRESSED_CTE, """
SELECT model,
       CASE WHEN sum((y - my) * (y - my)) > 0 THEN 1 - sum((y - pred) * (y - pred)) / sum((y - my) * (y - my))
            WHEN sum((y - pred) * (y - pred)) = 0 THEN 1.0 ELSE 0.0 END AS r2,
       avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse,
       avg(abs(y - pred) / greatest(abs(y), 2.220446049250313e-16)) AS mape
FROM (SELECT *, avg(y) OVER (PARTITION BY model) AS my FROM regressed) GROUP BY model"""),
       doubles=("r2", "mae", "rmse", "mape"))
def eval_regression(spark, sf):
    """E5: R², MAE, RMSE, MAPE per regressor."""
    return E.regression_metrics(regressed(spark, sf))


@query("eval_auc_ovr", with_ctes(PROBA3_CTE + """,
long AS (SELECT p.y AS yy, u.cls - 1 AS cls, u.p FROM proba3 p,
         LATERAL (SELECT generate_subscripts(p.prob, 1) AS cls, unnest(p.prob) AS p) u),
lb AS (SELECT cls, p, CAST(yy = cls AS INTEGER) AS y FROM long),
sc AS (SELECT cls, p, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM lb GROUP BY cls, p),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY cls ORDER BY p DESC) AS cum_pos,
                  sum(pos) OVER (PARTITION BY cls) AS tot_pos,
                  sum(neg) OVER (PARTITION BY cls) AS tot_neg FROM sc),
auc AS (SELECT cls, sum(neg * (cum_pos - pos / 2.0)) / (max(tot_pos) * max(tot_neg)) AS roc_auc
        FROM cum GROUP BY cls),
sup AS (SELECT y AS cls, count(*) AS n FROM proba3 GROUP BY y)""", """
SELECT sum(roc_auc * n) / sum(n) AS roc_auc_ovr FROM auc JOIN sup USING (cls)"""),
       doubles=("roc_auc_ovr",))
def eval_auc_ovr(spark, sf):
    """3-class one-vs-rest ROC-AUC weighted by prevalence."""
    return E.auc_ovr_weighted(proba3(spark, sf))


@query("eval_by_subgroup", with_ctes(decided_cte() + """,
cm AS (SELECT model, status AS subgroup, y AS actual, pred AS predicted, count(*) AS cnt
       FROM decided GROUP BY ALL),
pc AS (
  SELECT model, subgroup, cls, sum(support) AS support, sum(predicted_n) AS predicted_n, sum(tp) AS tp FROM (
    SELECT model, subgroup, actual AS cls, cnt AS support, 0 AS predicted_n,
           CASE WHEN actual = predicted THEN cnt ELSE 0 END AS tp FROM cm
    UNION ALL
    SELECT model, subgroup, predicted AS cls, 0, cnt, 0 FROM cm)
  GROUP BY model, subgroup, cls),
pm AS (SELECT *, CASE WHEN predicted_n > 0 THEN tp / predicted_n ELSE 0.0 END AS prec,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM pc)""", """
SELECT model, subgroup, sum(tp) / sum(support) AS accuracy,
       sum(prec * support) / sum(support) AS precision, sum(rec * support) / sum(support) AS recall,
       sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * support)
         / sum(support) AS f1,
       CAST(sum(support) AS BIGINT) AS n
FROM pm GROUP BY model, subgroup"""), doubles=METRICS)
def eval_by_subgroup(spark, sf):
    """Classification metrics per model and order status."""
    return E.by_subgroup(decided(spark, sf, extra=("status",)), "status")


_CONF_COLS = """
list_max(prob) AS probability_confidence,
CASE WHEN len(prob) < 2 THEN list_max(prob)
     ELSE (list_sort(prob, 'DESC')[1] - list_sort(prob, 'DESC')[2] + 1) / 2 END AS margin_confidence,
list_sum(list_transform(prob, lambda x: -x * ln(x + 1e-10))) / ln(len(prob)) AS uncertainty"""


@query("conf_probability", with_ctes(PROBA3_CTE, "SELECT id AS prediction_id, list_max(prob) AS confidence FROM proba3"),
       doubles=("confidence",))
def conf_probability(spark, sf):
    """Highest class probability per row."""
    p = proba3(spark, sf)
    return p.select(F.col("id").alias("prediction_id"),
                    U.probability_confidence(F.col("prob")).alias("confidence"))


@query("conf_margin", with_ctes(PROBA3_CTE, """
SELECT id AS prediction_id, CASE WHEN len(prob) < 2 THEN list_max(prob)
     ELSE (list_sort(prob, 'DESC')[1] - list_sort(prob, 'DESC')[2] + 1) / 2 END AS margin
FROM proba3"""), doubles=("margin",))
def conf_margin(spark, sf):
    """Normalised margin of the top two classes."""
    p = proba3(spark, sf)
    return p.select(F.col("id").alias("prediction_id"), U.margin_confidence(F.col("prob")).alias("margin"))


@query("conf_uncertainty", with_ctes(PROBA3_CTE, """
SELECT id AS prediction_id,
       list_sum(list_transform(prob, lambda x: -x * ln(x + 1e-10))) / ln(len(prob)) AS uncertainty
FROM proba3"""), doubles=("uncertainty",))
def conf_uncertainty(spark, sf):
    """Normalised entropy."""
    p = proba3(spark, sf)
    return p.select(F.col("id").alias("prediction_id"), U.uncertainty(F.col("prob")).alias("uncertainty"))


@query("conf_levels", with_ctes(PROBA3_CTE, """
SELECT CASE WHEN c < 0.6 THEN 'Low' WHEN c < 0.8 THEN 'Medium' ELSE 'High' END AS confidence_level,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT list_max(prob) AS c FROM proba3) GROUP BY 1"""))
def conf_levels(spark, sf):
    """Rows per confidence level."""
    p = proba3(spark, sf)
    lvl = U.confidence_level(U.probability_confidence(F.col("prob")))
    return p.groupBy(lvl.alias("confidence_level")).agg(F.count(F.lit(1)).alias("n"))


@query("conf_reliability", with_ctes(PROBA3_CTE, f"""
SELECT prediction_id, probability_confidence, margin_confidence, uncertainty,
       CASE WHEN probability_confidence < 0.6 THEN 'Low'
            WHEN probability_confidence < 0.8 THEN 'Medium' ELSE 'High' END AS confidence_level,
       CAST(predicted_class AS INTEGER) AS predicted_class,
       probability_confidence * 0.5 + (1 - uncertainty) * 0.5 AS reliability_score
FROM (SELECT id AS prediction_id, {_CONF_COLS},
             list_position(prob, list_max(prob)) - 1 AS predicted_class FROM proba3)"""),
       doubles=("probability_confidence", "margin_confidence", "uncertainty", "reliability_score"))
def conf_reliability(spark, sf):
    """Reliability indicators per row."""
    return U.reliability(proba3(spark, sf))


@query("conf_flag_uncertain", with_ctes(PROBA3_CTE, """
SELECT id AS prediction_id, u AS uncertainty, u > 0.5 AS needs_review FROM (
  SELECT id, list_sum(list_transform(prob, lambda x: -x * ln(x + 1e-10))) / ln(len(prob)) AS u FROM proba3)"""),
       doubles=("uncertainty",))
def conf_flag_uncertain(spark, sf):
    """P10: rows whose uncertainty exceeds 0.5."""
    return U.flag_uncertain(proba3(spark, sf))


@query("conf_ensemble_agreement", with_ctes(decided_cte(), """
SELECT id AS prediction_id,
       CASE WHEN sum(votes) < 2 THEN 1.0 ELSE max(votes) / sum(votes) END AS agreement
FROM (SELECT id, pred, count(*) AS votes FROM decided GROUP BY id, pred) GROUP BY id"""),
       doubles=("agreement",))
def conf_ensemble_agreement(spark, sf):
    """U4: modal vote share across models per row."""
    return U.ensemble_agreement(decided(spark, sf))


@query("conf_distribution", with_ctes(PROBA3_CTE, """
SELECT avg(c) AS mean_confidence, stddev_pop(c) AS std_confidence, min(c) AS min_confidence,
       max(c) AS max_confidence,
       sum(CASE WHEN c > 0.8 THEN 1 ELSE 0 END) / count(*) * 100 AS pct_high_confidence,
       sum(CASE WHEN c >= 0.6 AND c <= 0.8 THEN 1 ELSE 0 END) / count(*) * 100 AS pct_medium_confidence,
       sum(CASE WHEN c < 0.6 THEN 1 ELSE 0 END) / count(*) * 100 AS pct_low_confidence,
       quantile_cont(c, 0.5) AS median_confidence
FROM (SELECT list_max(prob) AS c FROM proba3)"""),
       doubles=("mean_confidence", "std_confidence", "min_confidence", "max_confidence",
                "pct_high_confidence", "pct_medium_confidence", "pct_low_confidence",
                "median_confidence"))
def conf_distribution(spark, sf):
    """Distribution of the confidence (exact median)."""
    return U.distribution(proba3(spark, sf))
