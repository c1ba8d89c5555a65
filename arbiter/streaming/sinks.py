"""Sinks that a restarted or replayed stream doesn't write twice, and windows that keep what comes too late.

A micro-batch writes under folders named by its number and overwrites them, so running it again (after a failure
between the write and the commit) leaves one copy.  Everything a batch needs of earlier ones is read from
those folders; the driver gets single rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _run(stream: DataFrame, write, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append_once(stream: DataFrame, out: str, checkpoint: str, key: str = "record_id", ts: str = "ts") -> None:
    """Append records, each ``key`` of a day once, however often files or batches are replayed (STR1, A2).

    A record that comes again carries its event time, so only the months of a batch are looked up, by partition pruning.  Of
    records of one batch that share key and day the first by time (then by a hash) stays; records without a key all stay.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"log_date": F.to_date(ts), "log_month": F.date_format(ts, "yyyy-MM")})
        cols = rows.columns
        order = F.struct(ts, F.xxhash64(F.to_json(F.struct(*cols))))
        keyed = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"), F.col("log_date").alias("_d")).agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")
        done = f"{out}/batch_id=*"
        earlier = [f"{out}/batch_id={i}" for i in range(n)]
        if n and any(_exists(spark, p) for p in (earlier[0], earlier[-1])):
            old = spark.read.option("basePath", out).parquet(done).where(F.col("batch_id") < n).select(
                F.col(key).alias("_k"), F.col("log_date").alias("_d"), F.col("log_month").cast("string").alias("_m"))
            months = [r[0] for r in rows.select("log_month").distinct().collect()]  # the months of one batch
            known = [m for m in months if m is not None]
            old = old.where(F.col("_m").isin(known) | F.col("_m").isNull() if None in months else F.col("_m").isin(known))
            same = (F.col(key) == F.col("_k")) & F.col("log_date").eqNullSafe(F.col("_d"))
            keyed = keyed.join(old, same, "left_anti")
        new = keyed.unionByName(rows.where(F.col(key).isNull()))
        # a month's rows meet in a task, or in several where they are many
        new.hint("rebalance", "log_month").write.mode("overwrite").partitionBy("log_month").parquet(f"{out}/batch_id={n}")

    _run(stream, write, checkpoint)


def records(spark: SparkSession, out: str) -> DataFrame:
    """What ``append_once`` has written."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*").drop("batch_id", "log_date", "log_month")


# ---------------------------------------------------------------- windows

STATS = ("n", "n_value", "sum_value")


def append_windows(events: DataFrame, out: str, checkpoint: str, ts: str = "ts", key: str = "event_type", value: str = "value",
                   window: str = "1 day", lateness: str = "1 hour") -> None:
    """Windowed statistics in append form, with the rows that came too late kept apart (STR2).

    The watermark is the latest event time of the batches before, less ``lateness``.  A batch's rows of windows that the
    watermark has passed, and rows without a time, go to ``late``; the others' counts and sums to ``partials``, pre-aggregated; windows that
    the watermark passes now are merged and appended to ``closed``, once.  No state is held in memory.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = watermark(spark, out, lateness, n)
        timed = batch.withColumn("_ts", F.col(ts).cast("timestamp"))
        e = timed.where("_ts is not null").withColumn("_w", F.window("_ts", window))  # window() would drop rows without a time
        late = F.lit(False) if before is None else F.col("_w.end") <= F.lit(before)
        aside = e.where(late).drop("_w").unionByName(timed.where("_ts is null")).drop("_ts")
        aside.write.mode("overwrite").parquet(f"{out}/late/batch_id={n}")
        part = e.where(~late).groupBy(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), F.col(key).alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.count(value).alias("n_value"), F.sum(F.col(value).cast("double")).alias("sum_value"), F.max("_ts").alias("last"))
        part.write.mode("overwrite").parquet(f"{out}/partials/batch_id={n}")
        after = watermark(spark, out, lateness, n + 1)
        done = F.lit(False) if after is None else F.col("window_end") <= F.lit(after)
        if before is not None:
            done = done & (F.col("window_end") > F.lit(before))
        _merged(_partials(spark, out, n + 1).where(done)).write.mode("overwrite").parquet(f"{out}/closed/batch_id={n}")

    _run(events, write, checkpoint)


def _read(spark: SparkSession, out: str, kind: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/{kind}").parquet(f"{out}/{kind}/batch_id=*")


def _partials(spark: SparkSession, out: str, before_batch: int) -> DataFrame:
    return _read(spark, out, "partials").where(F.col("batch_id") < before_batch)


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("window_start", "window_end", "key").agg(*[F.sum(c).alias(c) for c in STATS])


def watermark(spark: SparkSession, out: str, lateness: str, before_batch: int | None = None):
    """The watermark that the batches below ``before_batch`` (all, if None) have set; None before the first row."""
    if before_batch == 0 or not _exists(spark, f"{out}/partials"):
        return None
    done = _read(spark, out, "partials") if before_batch is None else _partials(spark, out, before_batch)
    return done.agg((F.max("last") - F.expr(f"interval {lateness}")).alias("w")).first()["w"]


def _shown(stats: DataFrame, key: str) -> DataFrame:
    return stats.select("window_start", "window_end", F.col("key").alias(key), "n", F.try_divide("sum_value", "n_value").alias("avg_value"), "sum_value")


def closed_windows(spark: SparkSession, out: str, key: str = "event_type") -> DataFrame:
    """Final windows, each appended once."""
    return _shown(_read(spark, out, "closed"), key)


def open_windows(spark: SparkSession, out: str, lateness: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Windows that the watermark hasn't passed, as they are now."""
    at = watermark(spark, out, lateness)
    rows = _read(spark, out, "partials")
    return _shown(_merged(rows.where(F.col("window_end") > F.lit(at)) if at is not None else rows), key)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came after their window had been closed, and rows without a time."""
    return _read(spark, out, "late").drop("batch_id")
