"""Model evaluation: classification and regression metrics for many models at once.

Input is a long frame ``[model, id, y, pred(, p)]``; every metric is a
``groupBy(model)`` aggregation, so all models are evaluated in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.operators.threshold import roc_auc

EPS = 2.220446049250313e-16  # float64 machine epsilon, the MAPE floor


def confusion(df: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
              pred: str = "pred") -> DataFrame:
    """Sparse confusion matrix ``[by.., actual, predicted, count]``.

    Zero cells are implicit; ``confusion_wide`` pivots to the dense form.
    """
    return (df.groupBy(*by, F.col(label).alias("actual"), F.col(pred).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("count")))


def confusion_wide(df: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                   pred: str = "pred") -> DataFrame:
    c = confusion(df, by, label, pred)
    return c.groupBy(*by, "actual").pivot("predicted").agg(F.first("count")).na.fill(0)


def confusion_dense(df: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                    pred: str = "pred") -> DataFrame:
    """Every (actual, predicted) pair of a group's classes, with zeros."""
    by = list(by)
    c = confusion(df, by, label, pred)
    both = F.array_sort(F.array_distinct(F.flatten(F.array(F.collect_set("actual"), F.collect_set("predicted")))))
    grid = c.groupBy(*by).agg(both.alias("_cls"))  # the classes of one group
    grid = grid.select(*by, "_cls", F.explode("_cls").alias("actual")).select(*by, "actual", F.explode("_cls").alias("predicted"))
    return grid.join(c, [*by, "actual", "predicted"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def _per_class_from_confusion(c, by):
    side = F.array(
        F.struct(F.col("actual").alias("cls"), F.col("count").alias("support"),
                 F.lit(0).cast("long").alias("predicted_n"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("count"))
                 .otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("count").alias("predicted_n"), F.lit(0).cast("long").alias("tp")))
    return (c.select(*by, F.inline(side))
            .groupBy(*by, "cls")
            .agg(F.sum("support").alias("support"), F.sum("predicted_n").alias("predicted_n"),
                 F.sum("tp").alias("tp")))


def classification_metrics(df: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                           pred: str = "pred") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1, zero-division 0."""
    return _metrics_from_confusion(confusion(df, by, label, pred), by)


def _metrics_from_confusion(c: DataFrame, by: Sequence[str]) -> DataFrame:
    pc = _per_class_from_confusion(c, by)
    prec = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    s = F.col("support")
    agg = [(F.sum("tp") / F.sum(s)).alias("accuracy"),
           (F.sum(prec * s) / F.sum(s)).alias("precision"),
           (F.sum(rec * s) / F.sum(s)).alias("recall"),
           (F.sum(f1 * s) / F.sum(s)).alias("f1")]
    return pc.groupBy(*by).agg(*agg) if by else pc.agg(*agg)


def regression_metrics(df: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                       pred: str = "pred") -> DataFrame:
    """R², MAE, RMSE, MAPE in one aggregation (E5)."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    e = y - p
    # the population variance is a stable one-pass moment: SST is it times n
    agg = [F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
           F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape")]
    out = df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    r2 = (F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
          .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.select(*by, r2.alias("r2"), "mae", "rmse", "mape")


def evaluate_models(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                    pred: str = "pred", score: str = "p") -> DataFrame:
    """Classification metrics plus ROC-AUC for every model (E8): two map-side
    combined aggregations of the scored rows, joined on the model."""
    m = classification_metrics(scored, by, label, pred)
    a = roc_auc(scored, by, label, score)
    return m.join(a, list(by), "left")


def best_model(metrics: DataFrame, metric: str = "f1", model: str = "model") -> DataFrame:
    """Model with the highest metric; missing counts as 0, name breaks ties."""
    w = Window.orderBy(F.coalesce(F.col(metric), F.lit(0.0)).desc(), F.col(model).asc())
    return (metrics.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select(model, F.lit(metric).alias("metric"),
                    F.coalesce(F.col(metric), F.lit(0.0)).alias("value")))


def model_comparison(metrics: DataFrame, metric: str = "f1", model: str = "model") -> DataFrame:
    """Metrics table with a display name and RECOMMENDED flag on the best model."""
    best = best_model(metrics, metric, model).select(F.col(model).alias("_best"))
    display = F.initcap(F.regexp_replace(F.col(model), "_", " "))
    out = metrics.join(best, metrics[model] == best["_best"], "left")
    return out.select(display.alias("model_name"), *metrics.columns,
                      F.when(F.col("_best").isNotNull(), F.lit("RECOMMENDED"))
                      .otherwise(F.lit("")).alias("status"))


def auc_ovr_weighted(proba: DataFrame, label: str = "y", prob: str = "prob",
                     by: Sequence[str] = ()) -> DataFrame:
    """Multiclass one-vs-rest ROC-AUC weighted by class prevalence."""
    by = list(by)
    long = proba.select(*by, F.col(label).alias("_y"), F.posexplode(prob).alias("cls", "p"))
    long = long.select(*by, "cls", "p", (F.col("_y") == F.col("cls")).cast("int").alias("y"))
    per = roc_auc(long, [*by, "cls"], "y", "p")
    support = (proba.groupBy(*by, F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n")))
    j = per.join(support, [*by, "cls"], "inner")
    agg = [(F.sum(F.col("roc_auc") * F.col("n")) / F.sum("n")).alias("roc_auc_ovr")]
    return j.groupBy(*by).agg(*agg) if by else j.agg(*agg)


def by_subgroup(df: DataFrame, subgroup: Column | str, by: Sequence[str] = ("model",),
                label: str = "y", pred: str = "pred", score: str | None = None) -> DataFrame:
    """Classification metrics per (model, subgroup), with the ROC-AUC if a score is given."""
    sg = F.col(subgroup) if isinstance(subgroup, str) else subgroup
    d = df.withColumn("subgroup", sg)
    m = classification_metrics(d, [*by, "subgroup"], label, pred)
    n = d.groupBy(*by, "subgroup").agg(F.count(F.lit(1)).alias("n"))
    out = m.join(n, [*by, "subgroup"], "inner")
    return out.join(roc_auc(d, [*by, "subgroup"], label, score), [*by, "subgroup"], "left") if score else out
