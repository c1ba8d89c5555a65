"""Streaming decision log: score -> threshold -> action -> audit append (STR1).

File source over the table itself (one file, or a folder of part files), a
stream-static join with the broadcast outcome dimension, and an append-only
parquet sink with a checkpoint, so a restarted job resumes exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.operators import audit as A
from arbiter.operators.common import broadcast_if_small
from arbiter.sources.tables import stream


def decision_stream(spark: SparkSession, source_dir: str, table: str, score: Callable[[DataFrame], Column],
                    key: str, ts: str, outcome: str, outcomes: DataFrame, model: str,
                    threshold: float = 0.5, max_files: int | None = None) -> DataFrame:
    """A streaming frame of audit prediction records.

    ``max_files`` bounds the files per micro-batch (unset: everything
    available, split by Spark's own defaults).
    """
    src = stream(spark, source_dir, table, max_files)
    p = score(src)
    d = src.select(F.col(key).alias("id"), F.col(ts).alias("ts"), p.alias("p"))
    d = (d.withColumn("pred", (F.col("p") >= F.lit(float(threshold))).cast("int"))
         .withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p")))
         .withColumn("outcome", F.lit(outcome)).withColumn("model", F.lit(model)))
    dim = broadcast_if_small(outcomes.select(F.col("outcome").alias("_o"), "positive_action", "negative_action"))
    j = d.join(dim, d["outcome"] == F.col("_o"), "left")
    j = j.withColumn("action", F.when(F.col("_o").isNull(), F.lit(None))
                     .when(F.col("pred") == 1, F.col("positive_action")).otherwise(F.col("negative_action")))
    return A.prediction_events(j, ts="ts", key="id", pred="pred", prob="p", confidence="confidence",
                               model="model", threshold=threshold, action="action")


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available, append to parquet, stop."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out_path))
    q.awaitTermination()
