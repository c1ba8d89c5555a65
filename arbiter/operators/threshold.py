"""Decision-threshold analysis over a scored frame ``[.., y, p]``.

The reference recounts the confusion matrix once per threshold (101 full
passes).  Here each row is mapped once to the index of the highest threshold
it clears, the table is aggregated to at most ``groups x 101`` rows (partial
aggregation before the shuffle), and the per-threshold counts are a reverse
running sum over that tiny table.  Curves (ROC/PR) use the two-level scan in
:mod:`arbiter.operators.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.operators.ordered import running_sums


def n_thresholds(step: float) -> int:
    """Number of thresholds in ``arange(0, 1 + step, step)``."""
    return int(len(np.arange(0, 1 + step, step)))


def threshold_index(score: Column, step: float, n: int) -> Column:
    """Largest ``i`` in ``[0, n)`` with ``i * step <= score``; -1 if none.

    ``floor(score / step)`` can be one off because ``i * step`` is not exact
    in binary; one correction step either way makes it exact.
    """
    s = F.lit(float(step))
    k0 = F.floor(score / s)
    k = (F.when((k0 + 1) * s <= score, k0 + 1)
         .when(k0 * s > score, k0 - 1)
         .otherwise(k0))
    k = F.least(F.greatest(k, F.lit(-1)), F.lit(n - 1))
    return F.when(score.isNull() | F.isnan(score), F.lit(-1)).otherwise(k).cast("int")


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1, specificity, accuracy with zero-division 0."""
    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision = div(tp, tp + fp)
    recall = div(tp, tp + fn)
    f1 = div(2 * precision * recall, precision + recall)
    return {
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "specificity": div(tn, tn + fp),
        "accuracy": div(tp + tn, tp + tn + fp + fn),
    }


def threshold_counts(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                     score: str = "p", step: float = 0.01) -> DataFrame:
    """``[by.., i, threshold_raw, tp, fp, tn, fn, n]`` for thresholds ``i * step``."""
    n = n_thresholds(step)
    by = list(by)
    y = F.col(label)
    k = threshold_index(F.col(score).cast("double"), step, n)
    per_k = (scored.select(*by, k.alias("k"), y.alias("_y"))
             .groupBy(*by, "k")
             .agg(F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("long").alias("pos"),
                  F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).cast("long").alias("neg"),
                  F.count(F.lit(1)).alias("rows")))
    keys = by or ["_grp"]
    if not by:
        per_k = per_k.withColumn("_grp", F.lit(0))
    # one row per group holding its <= n + 1 threshold buckets (bounded by the
    # threshold count, not the data); counts per threshold are array sums
    g = per_k.groupBy(*keys).agg(
        F.collect_list(F.struct("k", "pos", "neg")).alias("_b"),
        F.sum("pos").alias("tot_pos"), F.sum("neg").alias("tot_neg"), F.sum("rows").alias("n"))
    out = g.select(*keys, "_b", "tot_pos", "tot_neg", "n",
                   F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    above = F.filter("_b", lambda e: e["k"] >= F.col("i"))
    out = (out.withColumn("tp", F.aggregate(above, F.lit(0).cast("long"), lambda a, e: a + e["pos"]))
           .withColumn("fp", F.aggregate(above, F.lit(0).cast("long"), lambda a, e: a + e["neg"]))
           .withColumn("fn", F.col("tot_pos") - F.col("tp"))
           .withColumn("tn", F.col("tot_neg") - F.col("fp"))
           .withColumn("threshold_raw", F.col("i") * F.lit(float(step))))
    out = out.select(*keys, "i", "threshold_raw", "tp", "fp", "tn", "fn", "n")
    return out.drop("_grp") if not by else out


def analyze_thresholds(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                       score: str = "p", step: float = 0.01) -> DataFrame:
    """Metrics at every threshold, 4-dp metrics and 2-dp thresholds."""
    c = threshold_counts(scored, by, label, score, step)
    r = rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return c.select(*by, F.round("threshold_raw", 2).alias("threshold"),
                    *[F.round(v, 4).alias(k) for k, v in r.items()],
                    "tp", "fp", "tn", "fn")


def metrics_at_threshold(scored: DataFrame, threshold: float, by: Sequence[str] = ("model",),
                         label: str = "y", score: str = "p") -> DataFrame:
    """Unrounded metrics at one threshold (T2); one pass of conditional sums."""
    return compare_thresholds(scored, [threshold], by, label, score)


def compare_thresholds(scored: DataFrame, thresholds: Sequence[float],
                       by: Sequence[str] = ("model",), label: str = "y",
                       score: str = "p") -> DataFrame:
    """Metrics at a list of thresholds (T6), one aggregation for all of them."""
    # null and NaN scores are below every threshold, rows without a label don't count (as in T1)
    y, p = F.col(label), F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    aggs = []
    for j, t in enumerate(thresholds):
        hit = F.coalesce(p >= F.lit(float(t)), F.lit(False))
        aggs += [F.sum(F.when(hit & (y == 1), 1).otherwise(0)).cast("long").alias(f"tp{j}"),
                 F.sum(F.when(hit & (y == 0), 1).otherwise(0)).cast("long").alias(f"fp{j}"),
                 F.sum(F.when(~hit & (y == 0), 1).otherwise(0)).cast("long").alias(f"tn{j}"),
                 F.sum(F.when(~hit & (y == 1), 1).otherwise(0)).cast("long").alias(f"fn{j}")]
    wide = scored.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{j}").alias("tp"),
                              F.col(f"fp{j}").alias("fp"), F.col(f"tn{j}").alias("tn"),
                              F.col(f"fn{j}").alias("fn"))
                     for j, t in enumerate(thresholds)])
    long = wide.select(*by, F.inline(rows))
    r = rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return long.select(*by, "threshold", *[v.alias(k) for k, v in r.items()],
                       "tp", "fp", "tn", "fn")


def optimal_threshold(scored: DataFrame, metric: str = "f1", by: Sequence[str] = ("model",),
                      label: str = "y", score: str = "p", step: float = 0.01) -> DataFrame:
    """First threshold with the best *rounded* metric."""
    sweep = analyze_thresholds(scored, by, label, score, step)
    keys = list(by)
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc(), F.col("threshold").asc()) \
        if keys else Window.orderBy(F.col(metric).desc(), F.col("threshold").asc())
    return (sweep.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select(*keys, F.lit(metric).alias("metric"), "threshold",
                    F.col(metric).alias("value")))


def score_counts(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                 score: str = "p") -> DataFrame:
    """One row per distinct score: ``[by.., p, pos, neg]`` (map-side combined).

    Null and NaN scores are the lowest (negative infinity), rows without a label
    don't count: the same rule as in the sweep.
    """
    y = F.col(label)
    low = F.lit(float("-inf"))
    p = F.coalesce(F.nanvl(F.col(score).cast("double"), low), low)
    return (scored.where(y.isNotNull()).groupBy(*by, p.alias("p"))
            .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
                 F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg")))


def _curve_base(scored, by, label, score, descending):
    if not by:
        raise ValueError("curve operators need at least one group column")
    sc = score_counts(scored, by, label, score)
    return running_sums(sc, list(by), "p", ["pos", "neg"], descending=descending,
                        lead_cols=["pos", "neg"], totals=True)


def roc_curve(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
              score: str = "p") -> DataFrame:
    """ROC points with collinear points dropped, starting at threshold +inf (T4).

    A point (distinct score, descending) is kept when it is the first or last
    one or the next score's (pos, neg) counts differ from its own - the
    second difference of the cumulative curve is then non-zero.  The +inf
    start row is emitted next to each group's first point, in the same pass.
    """
    keys = list(by)
    c = _curve_base(scored, keys, label, score, descending=True)
    first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    keep = (first | F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    point = F.struct(F.col("p").alias("threshold"),
                     F.when(F.col("tot_neg") > 0, F.col("cum_neg") / F.col("tot_neg")).alias("fpr"),
                     F.when(F.col("tot_pos") > 0, F.col("cum_pos") / F.col("tot_pos")).alias("tpr"))
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    rows = F.when(first, F.array(origin, point)).otherwise(F.array(point))
    return c.where(keep).select(*keys, F.inline(rows))


def roc_auc(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
            score: str = "p") -> DataFrame:
    """Exact binary ROC-AUC (trapezoid = Mann-Whitney with mid-ranks) per group.

    Null when a group has only one class, like the reference's error path.
    """
    return auc_from_score_counts(score_counts(scored, by, label, score), list(by))


def auc_from_score_counts(sc: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC from ``[by.., p, pos, neg]`` (one row per distinct score)."""
    keys = list(by)
    c = running_sums(sc, keys, "p", ["pos", "neg"], descending=True, totals=True)
    part = (F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    agg = [F.sum(part).alias("_s"), F.first("tot_pos").alias("tot_pos"), F.first("tot_neg").alias("tot_neg")]
    g = c.groupBy(*keys).agg(*agg) if keys else c.agg(*agg)
    return g.select(*keys, F.when((F.col("tot_pos") > 0) & (F.col("tot_neg") > 0),
                                  F.col("_s") / (F.col("tot_pos") * F.col("tot_neg"))).alias("roc_auc"))


def pr_curve(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
             score: str = "p") -> DataFrame:
    """Precision-recall points per distinct score plus the (1, 0) end row (T5),
    emitted next to each group's first point in the same pass."""
    keys = list(by)
    c = _curve_base(scored, keys, label, score, descending=True)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    first = tp + fp == F.col("pos") + F.col("neg")
    point = F.struct(F.col("p").alias("threshold"),
                     F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
                     F.when(F.col("tot_pos") > 0, tp / F.col("tot_pos")).otherwise(F.lit(1.0)).alias("recall"))
    end_row = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                       F.lit(0.0).alias("recall"))
    rows = F.when(first, F.array(point, end_row)).otherwise(F.array(point))
    return c.select(*keys, F.inline(rows))
