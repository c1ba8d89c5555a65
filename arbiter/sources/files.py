"""File sources and sinks: CSV with header and inferred types, JSON logs.

Writes go to the shared folder named by ``spark.checkpoint.dir`` (never a
machine-local temp folder on a cluster), one fresh sub-folder per call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.operators.common import materialize
from arbiter.session import scratch_path


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one thing for the reference: fold NaN into null once, at ingest."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row; types inferred unless a schema is given."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return nan_to_null(r.csv(path))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
                     corrupt: str = "_broken") -> tuple[DataFrame, DataFrame]:
    """CSV rows, and the lines that don't fit (S1): ``(rows, [_broken, file])``.

    A line with too few or too many fields, or with a value that isn't of its column's type, is kept as text instead of a
    row of nulls.  Without a schema the types are inferred over all part files, so a column that is whole numbers in one
    file and fractions in another is widened.  The parsed table is written once, so both results come from one read.
    """
    if schema is None:
        schema = spark.read.option("header", header).option("inferSchema", True).csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = (spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
              .option("enforceSchema", True).schema(full).csv(path).withColumn("_file", F.input_file_name()))
    parsed = materialize(parsed)
    good = F.col(corrupt).isNull()
    return nan_to_null(parsed.where(good).drop(corrupt, "_file")), parsed.where(~good).select(corrupt, F.col("_file").alias("file"))


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "append", partition_by=()) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def roundtrip_csv(spark: SparkSession, df: DataFrame, name: str = "csv",
                  schema: T.StructType | None = None) -> DataFrame:
    path = write_csv(df, scratch_path(spark, name))
    return read_csv(spark, path, schema)


def roundtrip_json(spark: SparkSession, df: DataFrame, schema: T.StructType, name: str = "json") -> DataFrame:
    path = write_json(df, scratch_path(spark, name), mode="overwrite")
    return read_json(spark, path, schema)


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Nested map/struct/array fields become JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
