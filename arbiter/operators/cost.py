"""Cost-aware evaluation: price false positives and false negatives."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.operators.threshold import threshold_counts

DEFAULT_FP_COST = 100.0
DEFAULT_FN_COST = 500.0


def _cost_cols(tp: Column, fp: Column, tn: Column, fn: Column, n: Column,
               fp_cost, fn_cost) -> list[Column]:
    fpc = fp_cost if isinstance(fp_cost, Column) else F.lit(float(fp_cost))
    fnc = fn_cost if isinstance(fn_cost, Column) else F.lit(float(fn_cost))
    total = fp * fpc + fn * fnc
    return [fp.alias("false_positives"), fn.alias("false_negatives"),
            tp.alias("true_positives"), tn.alias("true_negatives"),
            fpc.alias("fp_cost"), fnc.alias("fn_cost"),
            (fp * fpc).alias("total_fp_cost"), (fn * fnc).alias("total_fn_cost"),
            total.alias("total_cost"),
            F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("average_cost_per_decision")]


def confusion_counts(decided: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                     pred: str = "pred") -> DataFrame:
    """``[by.., tp, fp, tn, fn, n]`` for 0/1 predictions, one aggregation."""
    y, p = F.col(label), F.col(pred)
    aggs = [F.sum(F.when((p == 1) & (y == 1), 1).otherwise(0)).cast("long").alias("tp"),
            F.sum(F.when((p == 1) & (y == 0), 1).otherwise(0)).cast("long").alias("fp"),
            F.sum(F.when((p == 0) & (y == 0), 1).otherwise(0)).cast("long").alias("tn"),
            F.sum(F.when((p == 0) & (y == 1), 1).otherwise(0)).cast("long").alias("fn"),
            F.count(F.lit(1)).alias("n")]
    return decided.groupBy(*by).agg(*aggs) if by else decided.agg(*aggs)


def _resolve(cost, default):
    # only None falls back to the default (a cost of 0 is a valid cost)
    return default if cost is None else cost


def expected_cost(decided: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                  pred: str = "pred", fp_cost: float | None = None,
                  fn_cost: float | None = None) -> DataFrame:
    """Cost breakdown of 0/1 predictions."""
    c = confusion_counts(decided, by, label, pred)
    return c.select(*by, *_cost_cols(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"),
                                     F.col("n"), _resolve(fp_cost, DEFAULT_FP_COST),
                                     _resolve(fn_cost, DEFAULT_FN_COST)))


def compare_model_costs(decided: DataFrame, model: str = "model", label: str = "y",
                        pred: str = "pred", fp_cost=None, fn_cost=None) -> DataFrame:
    """Cost per model with a rank column, cheapest first."""
    c = expected_cost(decided, [model], label, pred, fp_cost, fn_cost)
    w = Window.orderBy(F.col("total_cost").asc(), F.col(model).asc())
    # the frame has one row per model: a global window over it is tiny
    return c.withColumn("cost_rank", F.row_number().over(w))


def optimal_model(decided: DataFrame, model: str = "model", label: str = "y",
                  pred: str = "pred", fp_cost=None, fn_cost=None) -> DataFrame:
    """Cheapest model."""
    return (compare_model_costs(decided, model, label, pred, fp_cost, fn_cost)
            .where("cost_rank = 1").drop("cost_rank"))


def threshold_vs_cost(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                      score: str = "p", fp_cost=None, fn_cost=None,
                      step: float = 0.01) -> DataFrame:
    """Cost at every threshold ``i * step`` (C4)."""
    c = threshold_counts(scored, by, label, score, step)
    return c.select(*by, F.round("threshold_raw", 2).alias("threshold"),
                    *_cost_cols(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"), F.col("n"),
                                _resolve(fp_cost, DEFAULT_FP_COST),
                                _resolve(fn_cost, DEFAULT_FN_COST)))


def optimal_threshold(scored: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                      score: str = "p", fp_cost=None, fn_cost=None,
                      step: float = 0.01) -> DataFrame:
    """First threshold with the minimum total cost."""
    curve = threshold_vs_cost(scored, by, label, score, fp_cost, fn_cost, step)
    keys = list(by)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()) \
        .orderBy(F.col("total_cost").asc(), F.col("threshold").asc())
    return curve.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cost_sensitivity(decided: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                     pred: str = "pred", fp_range=(10.0, 1000.0), fn_range=(10.0, 1000.0),
                     steps: int = 5) -> DataFrame:
    """Cost over an FP x FN unit-cost grid (C6): one confusion pass, grid exploded after."""
    fps = [float(v) for v in np.linspace(fp_range[0], fp_range[1], steps)]
    fns = [float(v) for v in np.linspace(fn_range[0], fn_range[1], steps)]
    c = confusion_counts(decided, by, label, pred)
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in fps for b in fns])
    g = c.select("*", F.explode(grid).alias("_g"))
    return g.select(*by, *_cost_cols(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"),
                                     F.col("n"), F.col("_g.a"), F.col("_g.b")))


def cost_benefit(decided: DataFrame, by: Sequence[str] = ("model",), label: str = "y",
                 pred: str = "pred", benefit_per_tp: float = 1000.0,
                 fp_cost=None, fn_cost=None) -> DataFrame:
    """Net benefit and ROI of 0/1 predictions."""
    c = expected_cost(decided, by, label, pred, fp_cost, fn_cost)
    benefit = F.col("true_positives") * F.lit(float(benefit_per_tp))
    net = benefit - F.col("total_cost")
    return c.select(*by, benefit.alias("total_benefit"), F.col("total_cost"),
                    net.alias("net_benefit"),
                    F.when(F.col("total_cost") > 0, net / F.col("total_cost") * 100)
                    .otherwise(F.lit(0.0)).alias("roi"))
