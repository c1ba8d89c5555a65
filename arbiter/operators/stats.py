"""Exact order statistics without one-task buffers.

``percentile`` (exact) keeps every value of a group in one aggregation
buffer; at scale a group can be a third of the table.  Here values are
first counted per distinct value (map-side combined), ranked with the
two-level scan, and the rows holding the wanted ranks are picked out.
Linear interpolation between neighbours matches NumPy / ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators.ordered import running_sums


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float],
                    by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """``[by.., <name>_idx, <name>]``: one row per (group, q) with the exact
    linear-interpolated quantile of ``col`` (nulls ignored)."""
    by = list(by)
    keys = by or ["_grp"]
    src = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    if not by:
        src = src.withColumn("_grp", F.lit(0))
    counts = src.groupBy(*keys, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sums(counts, keys, "_v", ["_c"], totals=True)
    # 0-based rank positions wanted per q
    qarr = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(q)).alias("q")) for j, q in enumerate(qs)])
    pos = (F.col("tot__c") - 1) * F.col("_q.q")
    lo, hi = F.floor(pos), F.ceil(pos)
    start = F.col("cum__c") - F.col("_c")  # rank of the first copy of this value
    cand = cum.select(*keys, "_v", "_c", "cum__c", "tot__c", F.explode(qarr).alias("_q"))
    cand = cand.select(*keys, "_v", F.col("_q.j").alias("j"), pos.alias("pos"),
                       ((start <= lo) & (lo < F.col("cum__c"))).alias("is_lo"),
                       ((start <= hi) & (hi < F.col("cum__c"))).alias("is_hi"))
    picked = cand.where("is_lo OR is_hi").groupBy(*keys, "j").agg(
        F.max(F.when(F.col("is_lo"), F.col("_v"))).alias("v_lo"),
        F.max(F.when(F.col("is_hi"), F.col("_v"))).alias("v_hi"),
        F.first("pos").alias("pos"))
    val = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.floor("pos"))
    out = picked.select(*keys, F.col("j").alias(f"{name}_idx"), val.alias(name))
    return out.drop("_grp") if not by else out


def exact_median(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_quantiles(df, col, [0.5], by, name).drop(f"{name}_idx")
