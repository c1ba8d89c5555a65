"""Stored quantile sketches: one mergeable KLL sketch a column and part of a table, merged on read.

An opt-in for quantiles (G4, U7, the candidates of K1) of tables that grow by parts: a new part adds a few rows of
sketches, and no part is read again.  The rank of an estimate is within 1 % of the one asked for with 99 %
confidence (``k`` = 400; twice ``k`` halves it).  The exact quantiles of ``stats`` stay the default everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 400
SCHEMA = "feature string, n long, missing long, least double, most double, sketch binary"


def sketch(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``[by.., feature, n, missing, least, most, sketch]``: one row a column (and group); NaN counts as missing."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v")) for c in cols])
    long = df.select(*by, F.inline(cells)).withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    return long.groupBy(*by, "feature").agg(F.count("_v").alias("n"), F.count(F.when(F.col("_v").isNull(), 1)).alias("missing"), F.min("_v").alias("least"),
                                            F.max("_v").alias("most"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def store(sketches: DataFrame, path: str, part: str) -> str:
    """Write the sketches of one part of the table; the same part again replaces them."""
    sketches.write.mode("overwrite").parquet(f"{path}/part={part}")
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """All stored sketches (group columns, if there are any, as they were written), with the column ``part``."""
    return spark.read.option("basePath", path).parquet(f"{path}/part=*")


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a column (and group) over all parts."""
    return sketches.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("least").alias("least"),
                                                F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(merged: DataFrame, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``[by.., feature, fraction, idx, value]``; the fractions 0 and 1 are the exact ends; columns without a value have no rows."""
    def value(f: float):
        return F.col("least") if f <= 0 else F.col("most") if f >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(f)))
    each = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(i).alias("idx"), value(f).alias("value")) for i, f in enumerate(fractions)])
    return merged.where(F.col("n") > 0).select(*by, "feature", F.inline(each))


def ranks(merged: DataFrame, at: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The share of a column's values at or below ``at.value`` (``[by.., feature, value]``), from its sketch."""
    return at.join(merged.where(F.col("n") > 0).select(*by, "feature", "sketch"), [*by, "feature"]).withColumn(
        "rank", F.kll_sketch_get_rank_double("sketch", F.col("value"))).drop("sketch")
