"""Append-only decision audit log: one declared schema for three event kinds.

Batch: build event frames from scored data and append them to a table.
Streaming: the same projections run under ``readStream`` (see
:mod:`arbiter.streaming.decisions`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.operators.ordered import running_sums

AUDIT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("record_id", T.LongType(), True),
    T.StructField("prediction", T.IntegerType(), True),
    T.StructField("probability", T.DoubleType(), True),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("confidence_level", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("recommended_action", T.StringType(), True),
    T.StructField("features", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("old_threshold", T.DoubleType(), True),
    T.StructField("new_threshold", T.DoubleType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("changed_by", T.StringType(), True),
    T.StructField("prediction_id", T.LongType(), True),
    T.StructField("action", T.StringType(), True),
    T.StructField("action_result", T.StringType(), True),
    T.StructField("actioned_by", T.StringType(), True),
])

# fixed values: the logger's level bands (strictly greater than)
LEVEL_HIGH, LEVEL_MEDIUM = 0.8, 0.6


def logger_level(conf: Column) -> Column:
    return (F.when(conf > LEVEL_HIGH, "High").when(conf > LEVEL_MEDIUM, "Medium").otherwise("Low"))


def conform(df: DataFrame) -> DataFrame:
    """Project any event frame onto the audit schema (missing fields null)."""
    cols = []
    for f in AUDIT_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def prediction_events(df: DataFrame, ts: str = "ts", key: str = "id", pred: str = "pred",
                      prob: str = "p", confidence: str = "confidence", model: str = "model",
                      threshold: float = 0.5, action: str | None = "action",
                      feature_cols=(), metadata: dict | None = None,
                      metadata_col: Column | None = None) -> DataFrame:
    """Prediction records (A1).  ``record_id`` is the caller's stable key."""
    conf = F.col(confidence)
    feats = (F.map_from_arrays(F.array(*[F.lit(c) for c in feature_cols]),
                               F.array(*[F.format_string("%.2f", F.col(c).cast("double")) for c in feature_cols]))
             if feature_cols else F.lit(None))
    meta = (F.create_map(*[e for k, v in (metadata or {}).items() for e in (F.lit(k), F.lit(str(v)))])
            if metadata else F.lit(None))
    if metadata_col is not None:
        meta = metadata_col
    out = df.select(F.col(ts).cast("timestamp").alias("ts"), F.lit("prediction").alias("event_type"),
                    F.col(key).cast("long").alias("record_id"), F.col(pred).cast("int").alias("prediction"),
                    F.col(prob).cast("double").alias("probability"), conf.cast("double").alias("confidence"),
                    logger_level(conf).alias("confidence_level"), F.col(model).alias("model"),
                    F.lit(float(threshold)).alias("threshold"),
                    (F.col(action) if action else F.lit(None)).cast("string").alias("recommended_action"),
                    feats.alias("features"), meta.alias("metadata"))
    return conform(out)


def batch_events(df: DataFrame, batch: Column, key: str = "id", tie: str | None = None, **kw) -> DataFrame:
    """Batch records: ``metadata`` holds ``batch_id`` and ``batch_index`` (position
    in key order within the batch, from the two-level scan) (A2).  Records without a time or key
    are logged too (null batch, first places); ``tie`` orders records that share a key."""
    d = df.withColumn("_batch", batch.cast("string")).withColumn("_one", F.lit(1))
    r = running_sums(d, ["_batch"], key, ["_one"], include_ties=False, tie_breaker=tie or key)
    meta = F.create_map(F.lit("batch_id"), F.col("_batch"),
                        F.lit("batch_index"), (F.col("cum__one") - 1).cast("string"))
    return prediction_events(r, key=key, metadata_col=meta, **kw)


def threshold_events(df: DataFrame, ts: str, model: str, old: str, new: str,
                     reason: str | None = None, changed_by: str | None = None) -> DataFrame:
    """Threshold-change records (A3)."""
    return conform(df.select(F.col(ts).cast("timestamp").alias("ts"), F.lit("threshold_change").alias("event_type"),
                             F.col(model).alias("model"), F.col(old).alias("old_threshold"),
                             F.col(new).alias("new_threshold"), F.lit(reason).alias("reason"),
                             F.lit(changed_by).alias("changed_by")))


def action_events(df: DataFrame, ts: str, prediction_id: str, action: str,
                  result: str | None = None, by: str | None = None) -> DataFrame:
    """Action-taken records (A4)."""
    return conform(df.select(F.col(ts).cast("timestamp").alias("ts"), F.lit("action_taken").alias("event_type"),
                             F.col(prediction_id).cast("long").alias("prediction_id"), F.col(action).alias("action"),
                             F.lit(result).alias("action_result"), F.lit(by).alias("actioned_by")))


def trail(log: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Records whose ``record_id`` or ``prediction_id`` is in ``ids`` (A5)."""
    k = F.coalesce(F.col("record_id"), F.col("prediction_id"))
    return (log.withColumn("trail_id", k)
            .join(ids.select(F.col(id_col).cast("long").alias("trail_id")).distinct(), "trail_id", "left_semi"))


def statistics(log: DataFrame) -> DataFrame:
    """Totals, confidence summary and bands, +/- counts, time range.
    With no prediction records every field but ``total_records`` is 0/null."""
    is_p = F.col("event_type") == "prediction"
    c = F.when(is_p, F.col("confidence"))
    return log.agg(
        F.count(F.lit(1)).alias("all_records"),
        F.count(c).alias("total_predictions"),
        F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
        F.count(F.when(c > 0.8, 1)).alias("high_confidence_count"),
        F.count(F.when((c >= 0.6) & (c <= 0.8), 1)).alias("medium_confidence_count"),
        F.count(F.when(c < 0.6, 1)).alias("low_confidence_count"),
        F.count(F.when(is_p & (F.col("prediction") == 1), 1)).alias("positive_predictions"),
        F.count(F.when(is_p & (F.col("prediction") == 0), 1)).alias("negative_predictions"),
        F.min(F.when(is_p, F.col("ts"))).alias("first_record_time"),
        F.max(F.when(is_p, F.col("ts"))).alias("last_record_time"),
    ).select(F.when(F.col("total_predictions") > 0, F.col("all_records")).otherwise(F.lit(0)).alias("total_records"),
             "*").drop("all_records")


def report(stats: DataFrame) -> DataFrame:
    """Audit report text."""
    n = F.col("total_predictions")

    def pct(c):
        x = F.col(c) / n * 100
        # ties that binary numbers hold exactly (.25, .75) go to the even digit, as in the fixed format
        return F.format_string("%.1f", F.when(x * 4 == F.floor(x * 4), F.bround(x, 1)).otherwise(x))
    text = F.concat(
        F.lit("=== AUDIT LOG REPORT ===\n\nSTATISTICS:\n- Total Records: "), F.col("total_records").cast("string"),
        F.lit("\n- Total Predictions: "), n.cast("string"),
        F.lit("\n- Avg Confidence: "), F.format_string("%.3f", F.col("avg_confidence")),
        F.lit("\n- High Confidence: "), F.col("high_confidence_count").cast("string"), F.lit(" ("), pct("high_confidence_count"),
        F.lit("%)\n- Medium Confidence: "), F.col("medium_confidence_count").cast("string"), F.lit(" ("),
        pct("medium_confidence_count"),
        F.lit("%)\n- Low Confidence: "), F.col("low_confidence_count").cast("string"), F.lit(" ("), pct("low_confidence_count"),
        F.lit("%)\n- Positive Predictions: "), F.col("positive_predictions").cast("string"),
        F.lit("\n- Negative Predictions: "), F.col("negative_predictions").cast("string"),
        F.lit("\n- Time Range: "), F.date_format("first_record_time", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit(" to "), F.date_format("last_record_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n"))
    return stats.select(F.when(F.col("total_records") == 0, F.lit("No audit records found.")).otherwise(text)
                        .alias("report"))


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    """Latest ``n`` records (prediction rows shown), display-trimmed."""
    k = F.coalesce(F.col("record_id"), F.col("prediction_id"))
    last = log.orderBy(F.col("ts").desc(), F.col("event_type").asc(), k.desc(),
                       F.coalesce("model", F.lit("")).asc()).limit(n)
    return last.where(F.col("event_type") == "prediction").select(
        F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 1, 19).alias("timestamp"),
        "model", "prediction", F.format_string("%.3f", F.col("confidence")).alias("confidence"),
        "threshold", F.substring(F.coalesce(F.col("recommended_action"), F.lit("")), 1, 50).alias("action"))


def append(log: DataFrame, path: str) -> str:
    """Append records to the audit table, partitioned by event date.

    Appends never rewrite earlier files, so concurrent writers and retried
    tasks only add whole files (the commit protocol discards partial ones).
    """
    (conform(log).withColumn("log_date", F.to_date("ts"))
     .write.mode("append").partitionBy("log_date").parquet(path))
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read the audit table back with the declared schema."""
    schema = T.StructType(AUDIT_SCHEMA.fields + [T.StructField("log_date", T.DateType(), True)])
    return conform(spark.read.schema(schema).parquet(path))


#: the log with payloads that keep their types
TYPED_SCHEMA = T.StructType([T.StructField(f.name, T.VariantType(), True) if f.name in ("features", "metadata") else f for f in AUDIT_SCHEMA.fields]
                            + [T.StructField("extra", T.VariantType(), True)])


def payload(*columns: Column) -> Column:
    """A typed payload of named columns (A1): numbers stay numbers, in the table and in its JSON."""
    return F.to_variant_object(F.struct(*columns))


def typed(df: DataFrame) -> DataFrame:
    """An event frame in the typed schema: missing fields are null, text maps become objects of strings, fields
    that the schema doesn't know are kept in ``extra``."""
    known = {f.name: f.dataType for f in TYPED_SCHEMA.fields}
    types = {f.name: f.dataType for f in df.schema.fields}

    def column(name):
        if name not in types:
            return F.lit(None).cast(known[name])
        if isinstance(known[name], T.VariantType) and not isinstance(types[name], T.VariantType):
            return F.when(F.col(name).isNotNull(), F.to_variant_object(F.col(name)) if isinstance(types[name], (T.MapType, T.StructType, T.ArrayType))
                          else F.col(name).cast("variant"))
        return F.col(name).cast(known[name]) if not isinstance(known[name], T.VariantType) else F.col(name)
    more = [F.col(f"`{c}`") for c in types if c not in known and c not in ("log_date", "log_month")]
    extra = F.to_variant_object(F.struct(*more)) if more and "extra" not in types else column("extra")
    return df.select(*[column(f.name).alias(f.name) for f in TYPED_SCHEMA.fields[:-1]], extra.alias("extra"))


def append_typed(log: DataFrame, path: str) -> str:
    """Append typed records, partitioned by event month."""
    rows = typed(log).withColumn("log_month", F.date_format("ts", "yyyy-MM")).hint("rebalance", "log_month")
    rows.write.mode("append").partitionBy("log_month").parquet(path)
    return path


def load_typed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Typed records of several tables, whichever fields each of them was written with."""
    parts = [typed(spark.read.parquet(p)) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clear(spark: SparkSession, path: str) -> str:
    """Replace the audit table with an empty one."""
    empty = spark.createDataFrame([], AUDIT_SCHEMA).withColumn("log_date", F.to_date("ts"))
    empty.write.mode("overwrite").partitionBy("log_date").parquet(path)
    return path
