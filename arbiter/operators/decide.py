"""Map predictions to business actions through an outcome dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.operators.common import broadcast_if_small

OUTCOME_SCHEMA = T.StructType([
    T.StructField("outcome", T.StringType(), False),
    T.StructField("positive_label", T.StringType(), True),
    T.StructField("negative_label", T.StringType(), True),
    T.StructField("positive_action", T.StringType(), True),
    T.StructField("negative_action", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("version", T.LongType(), False),
])

# fixed values: the action templates offered per domain
DOMAIN_TEMPLATES = {
    "Customer Churn": {
        "positive": ["Send retention offer", "Assign account manager", "Offer discount",
                     "Request feedback", "Do nothing"],
        "negative": ["Monitor account", "Send upsell offer", "Standard engagement", "No action"]},
    "Fraud Detection": {
        "positive": ["Block transaction", "Flag for review", "Request verification", "Approve with review"],
        "negative": ["Approve automatically", "Monitor account", "No action"]},
    "Loan Approval": {
        "positive": ["Approve", "Approve with conditions", "Request more info", "Manual review"],
        "negative": ["Reject", "Request more info", "Suggest alternatives"]},
    "Custom": {"positive": [], "negative": []},
}


def outcome_log(spark: SparkSession, definitions: Sequence[tuple]) -> DataFrame:
    """Definitions as an append log ``(outcome, +label, -label, +action, -action, desc, version)``."""
    return spark.createDataFrame(list(definitions), OUTCOME_SCHEMA)


def current_outcomes(log: DataFrame) -> DataFrame:
    """Upsert semantics: the latest version per outcome wins (D-1)."""
    w = Window.partitionBy("outcome").orderBy(F.col("version").desc())
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "version")


def actions(preds: DataFrame, outcomes: DataFrame, outcome_col: str = "outcome",
            pred: str = "pred", confidence: str | None = "confidence") -> DataFrame:
    """Action per prediction: 1 -> positive, anything else -> negative; an undefined
    outcome yields an ``error`` and null action (D-2).  The dimension is broadcast
    after a size check."""
    dim = broadcast_if_small(outcomes.select(
        F.col("outcome").alias("_o"), "positive_label", "negative_label", "positive_action",
        "negative_action", "description"))
    j = preds.join(dim, preds[outcome_col] == F.col("_o"), "left")
    pos = F.col(pred) == 1
    found = F.col("_o").isNotNull()
    cols = [c for c in preds.columns]
    return j.select(
        *cols,
        F.when(found, F.when(pos, F.col("positive_label")).otherwise(F.col("negative_label"))).alias("label"),
        F.when(found, F.when(pos, F.col("positive_action")).otherwise(F.col("negative_action"))).alias("action"),
        F.col("description"),
        F.when(~found, F.format_string("Outcome '%s' not defined", F.col(outcome_col))).alias("error"))


def decision_matrix(outcomes: DataFrame) -> DataFrame:
    """Two rows per outcome: prediction 1 and 0 with label and action (D-3)."""
    rows = F.array(F.struct(F.lit(1).alias("prediction"), F.col("positive_label").alias("label"),
                            F.col("positive_action").alias("action")),
                   F.struct(F.lit(0).alias("prediction"), F.col("negative_label").alias("label"),
                            F.col("negative_action").alias("action")))
    return outcomes.select("outcome", "description", F.inline(rows))


def templates(spark: SparkSession) -> DataFrame:
    """``[domain, sign, ordinal, action]`` from the fixed template table (D-4)."""
    rows = [(d, s, i, a) for d, v in DOMAIN_TEMPLATES.items() for s in ("positive", "negative")
            for i, a in enumerate(v[s])]
    return spark.createDataFrame(rows, "domain string, sign string, ordinal int, action string")


def export_outcomes(log: DataFrame, path: str) -> str:
    """Write the outcome definitions as JSON."""
    log.write.mode("overwrite").json(path)
    return path


def import_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Read outcome definitions back with the declared schema."""
    return spark.read.schema(OUTCOME_SCHEMA).json(path)
