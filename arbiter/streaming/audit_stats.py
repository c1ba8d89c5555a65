"""Windowed audit / event statistics with a late-data bound (STR2).

``withWatermark`` bounds how late a record may arrive (state for older
windows is dropped); ``append`` mode emits a window once the watermark
passes it, ``complete`` mode re-emits the (bounded) result table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.sources.tables import stream


def event_stream(spark: SparkSession, source_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    return stream(spark, source_dir, table, max_files)


def windowed_stats(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                   window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    # watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session time zone is UTC
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return (e.groupBy(F.window(ts, window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.sum(value).alias("sum_value")))


def run_complete(stats: DataFrame, name: str) -> None:
    """Complete mode into an in-memory table (the result is windows x keys, bounded)."""
    q = stats.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def flatten(stats: DataFrame, key: str = "event_type") -> DataFrame:
    return stats.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key,
                        "n", "avg_value", "sum_value")
