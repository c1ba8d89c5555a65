"""Small shared helpers."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row of ``df``.

    The one-row side is a global aggregate (size bound: one row), so it is
    broadcast; the join is an equi-join on a constant key.  If that side has
    no row at all, its columns are null and every row of ``df`` stays.
    """
    return (df.withColumn("_one", F.lit(0))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(0))), "_one", "left")
            .drop("_one"))


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a dimension only after checking its size; else a plain join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as parquet in the shared checkpoint folder and read it back.

    Used for derived tables that a plan references many times (each
    reference would otherwise replay the joins and windows that built it).
    The written table survives executor loss, and parquet keeps column
    pruning and gives AQE exact sizes for the joins that follow.
    """
    from arbiter.session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, "mat")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def literal_row(df: DataFrame) -> DataFrame:
    """Collect a one-row aggregate (a bounded parameter) and re-create it without lineage."""
    row = df.first()
    return df.sparkSession.createDataFrame([row], df.schema)


def with_key(df: DataFrame, key: str = "id") -> DataFrame:
    """Give rows an explicit key when the input has none (positions are not keys).

    The key is a 64-bit hash of all columns, so it is the same on every
    recomputation; identical rows share a key (the reference would treat
    them as separate positions).
    """
    if key in df.columns:
        return df
    return df.withColumn(key, F.xxhash64(*[F.col(c) for c in df.columns]))


def refused(error: Exception) -> bool:
    """Whether ``error`` says that data or settings can't be used, a result of a run that reports failures.

    Everything else (a job, worker, disk or memory that failed, an interruption, a fault in the code) says nothing about
    them and has to be raised.  Checks inside a job, as those of MLlib's labels, come as USER_RAISED_EXCEPTION.
    """
    condition = (error.getCondition() or "") if hasattr(error, "getCondition") else ""
    if isinstance(error, AnalysisException):
        return not condition.startswith("PATH_")  # a table that is gone
    return condition == "USER_RAISED_EXCEPTION" or isinstance(
        error, (ValueError, IllegalArgumentException, ArithmeticException, DateTimeException, NumberFormatException))
