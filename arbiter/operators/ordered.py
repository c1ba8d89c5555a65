"""Exact running sums and ranks in a global order, without one-partition windows.

A window ``ORDER BY x`` with no ``PARTITION BY`` (or partitioned only by a
low-cardinality key such as a model name) funnels the whole table through
one task.  Every ordered operator in the engine (AUC, ROC/PR curves, the KS
statistic, stratified splits, permutations) goes through the two-level scan
here instead:

1. each row gets an order-preserving bucket: either an explicit bucket
   expression supplied by the caller (e.g. a prefix of an md5 hash, which is
   uniform), or the index among approximate quantile cut points of the order
   value (``percentile_approx``, one bounded array per group);
2. a window partitioned by ``(group, bucket)`` computes the running values
   inside each bucket - many small, balanced tasks;
3. per-bucket totals (at most groups x buckets rows) are prefix-summed with
   a window over that small table and joined back as offsets.

The result is exact: cut points only decide the work split, never the
answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 1024
MAX_BUCKETS = 65_536               # cut points that are collected to the driver at most
BYTES_PER_TASK = 64 << 20          # what one window task should hold


def pieces_for(df: DataFrame, least: int) -> int:
    """Into how many pieces a group of ``df`` has to be cut so that each holds about
    ``BYTES_PER_TASK``; at least ``least``.

    The size is the sum of the scanned tables' sizes, which the plan knows without a job (the
    estimate above a join is the product of its sides); inputs of unknown size don't count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least, sum(s for s in sizes if s < 1 << 60) // BYTES_PER_TASK)


def _const_group(df: DataFrame, part: Sequence[str]):
    if part:
        return df, list(part)
    return df.withColumn("_grp", F.lit(0)), ["_grp"]


def global_cuts(df: DataFrame, order_col: str, buckets: int = DEFAULT_BUCKETS) -> list[float]:
    """Approximate quantile cut points of one column over the whole frame.

    One aggregation job; the result is a bounded parameter (at most
    ``buckets - 1`` doubles) collected to the driver.  Cuts over the union of
    all groups bound every ``(group, bucket)`` cell by about ``rows / buckets``
    rows, whatever the groups' own distributions are.
    """
    fr = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(order_col).cast("double"), fr, 10 * buckets)
                 .alias("c")).first()
    cuts = sorted({float(c) for c in (row["c"] or []) if c is not None and c == c})
    return [c for c in cuts if c not in (float("inf"), float("-inf"))]


def quantile_buckets(df: DataFrame, part: Sequence[str], order_col: str,
                     buckets: int | None = None) -> DataFrame:
    """Add ``_b``: order-preserving bucket of ``order_col`` (binary search, JVM); null order
    values have the null bucket.  The number of buckets follows the size of ``df``."""
    from pyspark.ml.feature import Bucketizer
    buckets = buckets or min(pieces_for(df, DEFAULT_BUCKETS), MAX_BUCKETS)
    splits = [float("-inf")] + global_cuts(df, order_col, buckets) + [float("inf")]
    if len(splits) < 3:
        return df.withColumn("_b", F.lit(0.0))
    tmp = df.withColumn("_bq", F.col(order_col).cast("double"))
    b = Bucketizer(splits=splits, inputCol="_bq", outputCol="_b", handleInvalid="keep")
    return b.transform(tmp).drop("_bq")


def running_sums(df: DataFrame, part: Sequence[str], order_col: str,
                 values: Sequence[str], descending: bool = False,
                 bucket: Column | None = None, buckets: int | None = None,
                 include_ties: bool = True, tie_breaker: str | None = None,
                 lead_cols: Sequence[str] = (), prefix: str = "cum_",
                 totals: bool = False) -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over rows at or before this one in order.

    ``include_ties=True`` gives SQL's default RANGE frame (all rows with the
    same order value are included); ``False`` with ``tie_breaker`` gives a
    ROWS frame, i.e. ``row_number``-style counting.  ``lead_cols`` adds
    ``next_<c>``: the value of ``c`` on the following row in order (across
    bucket boundaries), null on the last row.  ``totals=True`` adds
    ``tot_<v>``, the group total, from the per-bucket table (no extra pass).
    """
    added = not part
    df, part = _const_group(df, part)
    o = "_ord"
    df = df.withColumn(o, (-F.col(order_col)) if descending else F.col(order_col))
    if bucket is not None:
        df = df.withColumn("_b", bucket)
    else:
        df = quantile_buckets(df, part, o, buckets)

    order = [F.col(o)] + ([F.col(tie_breaker)] if tie_breaker else [])
    w_in = Window.partitionBy(*part, "_b").orderBy(*order)
    frame = (w_in.rangeBetween(Window.unboundedPreceding, Window.currentRow)
             if include_ties and not tie_breaker
             else w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for v in values:
        df = df.withColumn(f"_in_{v}", F.sum(v).over(frame))
    for c in lead_cols:
        df = df.withColumn(f"_lead_{c}", F.lead(c).over(w_in))

    aggs = [F.sum(v).alias(f"_tot_{v}") for v in values]
    first_struct = F.min(F.struct(*order, *[F.col(c) for c in lead_cols])) if lead_cols else None
    if first_struct is not None:
        aggs.append(first_struct.alias("_first"))
    per_b = df.groupBy(*part, "_b").agg(*aggs)
    w_b = Window.partitionBy(*part).orderBy("_b")
    w_prev = w_b.rowsBetween(Window.unboundedPreceding, -1)
    sel = [*part, "_b"] + [F.coalesce(F.sum(f"_tot_{v}").over(w_prev), F.lit(0)).alias(f"_off_{v}")
                           for v in values]
    if lead_cols:
        sel.append(F.lead("_first").over(w_b).alias("_nextfirst"))
    if totals:
        sel += [F.sum(f"_tot_{v}").over(Window.partitionBy(*part)).alias(f"tot_{v}") for v in values]
    offsets = per_b.select(*sel)

    # null-safe: a null group, key or order value has a bucket of its own, and its rows stay
    cond = None
    for c in [*part, "_b"]:
        offsets = offsets.withColumnRenamed(c, f"_j_{c}")
        same = F.col(c).eqNullSafe(F.col(f"_j_{c}"))
        cond = same if cond is None else cond & same
    out = df.join(offsets, cond, "inner").drop(*[f"_j_{c}" for c in [*part, "_b"]])
    for v in values:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_off_{v}") + F.col(f"_in_{v}"))
    for c in lead_cols:
        out = out.withColumn(f"next_{c}", F.coalesce(F.col(f"_lead_{c}"), F.col(f"_nextfirst.{c}")))
    drop = [o, "_b", "_first", "_nextfirst"] + [f"_{k}_{v}" for v in values for k in ("in", "off")] \
        + [f"_lead_{c}" for c in lead_cols]
    out = out.drop(*[d for d in drop if d in out.columns])
    if added:
        out = out.drop("_grp")
    return out


def hash_rank(df: DataFrame, part: Sequence[str], hash_col: str, tie_breaker: str,
              name: str = "rank", total_name: str | None = None) -> DataFrame:
    """``row_number() over (partition by part order by hash_col, tie_breaker)``.

    ``hash_col`` must be a hex md5 string: its first digits are a uniform,
    order-preserving bucket (three digits, 4096 buckets per group, or as many
    as the size of ``df`` asks for).
    ``total_name`` also returns the group size, taken from the per-bucket
    table (no extra pass).
    """
    tmp = df.withColumn("_one", F.lit(1))
    digits = min(8, math.ceil(math.log(pieces_for(df, 4096), 16) - 1e-9))
    out = running_sums(tmp, part, hash_col, ["_one"], bucket=F.substring(F.col(hash_col), 1, digits),
                       include_ties=False, tie_breaker=tie_breaker, totals=total_name is not None)
    out = out.withColumnRenamed("cum__one", name).drop("_one")
    return out.withColumnRenamed("tot__one", total_name) if total_name else out


def top_k(df: DataFrame, part: Sequence[str], order: Sequence, k: int, key: str,
          buckets: int | None = None, name: str = "rank") -> DataFrame:
    """Exact top-``k`` rows per group without one task holding a whole group.

    Rows are first cut to the top ``k`` inside ``(group, hash(key) % buckets)``
    cells (balanced, parallel); the global top ``k`` of a group is always
    among those survivors, so the final window sees at most ``k x buckets``
    rows per group.
    """
    part = list(part)
    buckets = buckets or pieces_for(df, 64)
    cell = F.pmod(F.hash(F.col(key)), F.lit(buckets))
    w1 = Window.partitionBy(*part, cell).orderBy(*order)
    pre = df.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    w2 = (Window.partitionBy(*part) if part else Window.partitionBy()).orderBy(*order)
    return pre.withColumn(name, F.row_number().over(w2)).where(F.col(name) <= k)
