"""Incremental audit statistics: mergeable partial states per day, merged on read.

Every append of records adds one row a day, under a folder of its own (``batch_id=..``) that a repeated append replaces, so
a batch that runs again doesn't count twice.  Statistics over years of records then read days x appends rows.
A state also holds a KLL sketch of the confidences, for quantiles with a stated rank error (opt-in; exact
quantiles over the records are ``stats.exact_quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KLL_K = 400                 # rank error below 1 % with 99 % confidence
SUMS = ("records", "predictions", "confidences", "high", "medium", "low", "positive", "negative")
STATE = "day date, " + ", ".join(f"{c} long" for c in SUMS) + ", total double, least double, most double, first timestamp, last timestamp, sketch binary"


def states(log: DataFrame) -> DataFrame:
    """One partial state a day of event (records without a time share one)."""
    is_p = F.col("event_type") == "prediction"
    c = F.when(is_p & ~F.isnan("confidence"), F.col("confidence"))
    n = lambda cond: F.count(F.when(cond, 1))
    ts = F.when(is_p, F.col("ts"))
    return log.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("records"), n(is_p).alias("predictions"), F.count(c).alias("confidences"), n(c > 0.8).alias("high"),
        n((c >= 0.6) & (c <= 0.8)).alias("medium"), n(c < 0.6).alias("low"), n(is_p & (F.col("prediction") == 1)).alias("positive"),
        n(is_p & (F.col("prediction") == 0)).alias("negative"), F.sum(c).alias("total"), F.min(c).alias("least"), F.max(c).alias("most"),
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.kll_sketch_agg_double(c, F.lit(KLL_K)).alias("sketch"))


def append(log: DataFrame, path: str, batch_id: int) -> str:
    """Add the states of one append; the same ``batch_id`` again replaces them."""
    states(log).write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path)


def merge(partial: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States merged over all days, or per column of ``by``."""
    return partial.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.kll_merge_agg_double("sketch").alias("sketch"))


def statistics(merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns of ``audit.statistics`` from merged states."""
    return merged.select(
        *by, F.when(F.col("confidences") > 0, F.col("records")).otherwise(F.lit(0)).alias("total_records"), F.col("confidences").alias("total_predictions"),
        F.try_divide("total", "confidences").alias("avg_confidence"), F.col("least").alias("min_confidence"), F.col("most").alias("max_confidence"),
        F.col("high").alias("high_confidence_count"), F.col("medium").alias("medium_confidence_count"), F.col("low").alias("low_confidence_count"),
        F.col("positive").alias("positive_predictions"), F.col("negative").alias("negative_predictions"),
        F.col("first").alias("first_record_time"), F.col("last").alias("last_record_time"))


def quantiles(merged: DataFrame, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``[by.., fraction, confidence]``: approximate quantiles from the merged sketches (null without a confidence)."""
    some = merged.where(F.col("confidences") > 0)
    each = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias("confidence")) for f in fractions])
    return some.select(*by, F.inline(each))
