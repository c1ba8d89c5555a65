"""Confidence and uncertainty of class-probability arrays ``prob ARRAY<DOUBLE>``.

All per-row measures are higher-order array expressions (no Python).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.operators.common import attach
from arbiter.operators.stats import exact_median

# fixed level bands of the estimator: Low < 0.6 <= Medium < 0.8 <= High
LOW, HIGH = 0.6, 0.8


def probability_confidence(prob: Column) -> Column:
    """Highest class probability."""
    return F.array_max(prob)


def margin_confidence(prob: Column) -> Column:
    """``(top1 - top2 + 1) / 2``; a single class falls back to U1."""
    s = F.sort_array(prob, asc=False)
    return F.when(F.size(prob) < 2, F.array_max(prob)).otherwise(
        (F.element_at(s, 1) - F.element_at(s, 2) + 1) / 2)


def uncertainty(prob: Column) -> Column:
    """Entropy ``-sum p ln(p + 1e-10)`` over ``ln K``."""
    ent = F.aggregate(prob, F.lit(0.0), lambda a, x: a - x * F.log(x + F.lit(1e-10)))
    return F.try_divide(ent, F.log(F.size(prob).cast("double")))  # one class: null


def confidence_level(conf: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Low / Medium / High bands."""
    return (F.when(conf < low, F.lit("Low")).when(conf < high, F.lit("Medium"))
            .otherwise(F.lit("High")))


def predicted_class(prob: Column) -> Column:
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def reliability(df: DataFrame, prob: str = "prob", key: str = "id") -> DataFrame:
    """Per-row reliability indicators."""
    p = F.col(prob)
    u1, u3 = probability_confidence(p), uncertainty(p)
    return df.select(
        F.col(key).alias("prediction_id"),
        u1.alias("probability_confidence"), margin_confidence(p).alias("margin_confidence"),
        u3.alias("uncertainty"), confidence_level(u1).alias("confidence_level"),
        predicted_class(p).alias("predicted_class"),
        (u1 * 0.5 + (1 - u3) * 0.5).alias("reliability_score"))


def flag_uncertain(df: DataFrame, prob: str = "prob", threshold: float = 0.5,
                   key: str = "id") -> DataFrame:
    """Rows whose normalised entropy exceeds the threshold (P10)."""
    u = uncertainty(F.col(prob))
    return df.select(F.col(key).alias("prediction_id"), u.alias("uncertainty"),
                     (u > F.lit(float(threshold))).alias("needs_review"))


def ensemble_agreement(decided: DataFrame, key: str = "id", model: str = "model",
                       pred: str = "pred") -> DataFrame:
    """Share of models voting for the modal class, per row (U4).

    Every model votes once per row, so the row's vote total is the model
    count: one aggregation, no separate pass for the number of models.
    """
    votes = decided.groupBy(key, pred).agg(F.count(F.lit(1)).alias("votes"))
    top = votes.groupBy(key).agg(F.max("votes").alias("top"), F.sum("votes").alias("n_models"))
    return top.select(F.col(key).alias("prediction_id"),
                      F.when(F.col("n_models") < 2, F.lit(1.0))
                      .otherwise(F.col("top") / F.col("n_models")).alias("agreement"))


def distribution(df: DataFrame, prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """Mean, exact median, population std, min, max and band shares of U1."""
    by = list(by)
    c = df.select(*by, probability_confidence(F.col(prob)).alias("conf"))
    n = F.count(F.lit(1))
    agg = [F.avg("conf").alias("mean_confidence"), F.stddev_pop("conf").alias("std_confidence"),
           F.min("conf").alias("min_confidence"), F.max("conf").alias("max_confidence"),
           (F.sum(F.when(F.col("conf") > HIGH, 1).otherwise(0)) / n * 100).alias("pct_high_confidence"),
           (F.sum(F.when((F.col("conf") >= LOW) & (F.col("conf") <= HIGH), 1).otherwise(0)) / n * 100)
           .alias("pct_medium_confidence"),
           (F.sum(F.when(F.col("conf") < LOW, 1).otherwise(0)) / n * 100).alias("pct_low_confidence")]
    g = c.groupBy(*by).agg(*agg) if by else c.agg(*agg)
    med = exact_median(c, "conf", by, "median_confidence")
    return g.join(med, by, "inner") if by else attach(g, med)
