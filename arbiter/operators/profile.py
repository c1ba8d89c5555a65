"""Table profiling: column kinds, missing values, distinct counts, target ranking,
and the tables behind the column charts.

Every per-column statistic for all columns is computed in one aggregation
and turned long with ``stack``; nothing loops over columns with one job each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, NumericType, StringType, TimestampNTZType,
                               TimestampType)

from arbiter.operators.common import attach
from arbiter.operators.ordered import top_k
from arbiter.operators.stats import exact_median

# fixed values of the reference's rules
MISSING_DROP_FRACTION = 0.5       # columns with more than this share missing are dropped
MIN_ROWS, MIN_COLS = 10, 2        # validation minimums
ID_NAME_TOKENS = ("id", "uuid", "guid", "key")
DISCRETE_MAX_UNIQUE = 15


def kind(dt) -> str:
    if isinstance(dt, BooleanType):
        return "boolean"
    if isinstance(dt, NumericType):
        return "numeric"
    if isinstance(dt, StringType):
        return "categorical"
    if isinstance(dt, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    return "other"


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if kind(f.dataType) == "numeric" and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if kind(f.dataType) == "categorical" and f.name not in exclude]


def _missing(c: str, dt):
    col = F.col(c)
    if isinstance(dt, NumericType) and not isinstance(dt, BooleanType):
        # NaN and null are the same thing for the reference (pandas)
        return col.isNull() | F.isnan(col.cast("double"))
    return col.isNull()


def _long(df: DataFrame, stats: dict[str, callable], cols: Sequence[str] | None = None,
          with_rows: bool = False) -> DataFrame:
    """One aggregation computing ``stats`` for every column, returned long:
    ``[column, ordinal, <stat>...]`` (plus ``n_rows`` from the same pass)."""
    fields = [f for f in df.schema.fields if cols is None or f.name in cols]
    aggs = [F.count(F.lit(1)).alias("n_rows")] if with_rows else []
    for i, f in enumerate(fields):
        for s, fn in stats.items():
            aggs.append(fn(f.name, f.dataType).alias(f"{s}__{i}"))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"),
                              F.lit(f.dataType.simpleString()).alias("dtype"),
                              F.lit(kind(f.dataType)).alias("kind"),
                              *[F.col(f"{s}__{i}").alias(s) for s in stats])
                     for i, f in enumerate(fields)])
    return wide.select(*(["n_rows"] if with_rows else []), F.inline(rows))


def column_types(df: DataFrame) -> DataFrame:
    """Column, Spark type, kind and non-null count."""
    return _long(df, {"non_null": lambda c, dt: F.count(F.when(~_missing(c, dt), 1))})


def summary(df: DataFrame) -> DataFrame:
    """Rows, columns, per-column missing count and % (2 dp) (G1)."""
    out = _long(df, {"missing": lambda c, dt: F.count(F.when(_missing(c, dt), 1))}, with_rows=True)
    return out.select("column_name", "ordinal", "dtype", "kind", "n_rows",
                      F.lit(len(df.columns)).alias("n_columns"),
                      F.col("missing").cast("long").alias("missing"),
                      F.round(F.try_divide(F.col("missing"), F.col("n_rows")) * 100, 2).alias("missing_pct"))


def total_missing(df: DataFrame) -> DataFrame:
    """Total missing cells."""
    return summary(df).agg(F.sum("missing").cast("long").alias("total_missing"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, name: str = "unique") -> DataFrame:
    """``[column_name, <name>]``: exact distinct non-null values of many columns in one pass.

    Columns are melted to (column, value) and counted with map-side combine: what is shuffled are
    the distinct values of each task, where many ``count(distinct ..)`` in one aggregation expand
    every row once per column.
    """
    cols = list(cols) if cols is not None else df.columns
    kinds = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _cell(c, kinds[c]).alias("value")) for c in cols])
    d = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    return d.groupBy("column_name").agg(F.count(F.lit(1)).alias(name))


def _cell(c: str, kind: str):
    x = F.col(f"`{c}`")
    x = x + F.lit(0.0) if kind in ("double", "float") else x  # -0.0 is 0.0
    return x.cast("string")


def _with_distinct(df: DataFrame, stats: dict, name: str, approx: bool, cols=None, with_rows: bool = False) -> DataFrame:
    """``_long`` with a distinct count: exact, or HyperLogLog sketches (``approx``) in the same aggregation."""
    if approx:
        return _long(df, stats | {name: lambda c, dt: F.approx_count_distinct(F.col(c), 0.01)}, cols, with_rows)
    out = _long(df, stats, cols, with_rows).join(F.broadcast(distinct_counts(df, cols, name)), "column_name", "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))  # one row per column


def schema_table(df: DataFrame, approx: bool = False) -> DataFrame:
    """Column, type, missing, distinct non-null values."""
    return _with_distinct(df, {"missing": lambda c, dt: F.count(F.when(_missing(c, dt), 1))}, "unique", approx)


def validate(df: DataFrame, target: str | None = None) -> DataFrame:
    """Non-empty, >= 10 rows, >= 2 columns, target present (P2/P3); one row."""
    n = df.limit(MIN_ROWS).agg(F.count(F.lit(1)).alias("n"))
    ncols = len(df.columns)
    has_target = target is None or target in df.columns
    msg = (F.when(F.col("n") == 0, F.lit("Dataset is empty."))
           .when(F.col("n") < MIN_ROWS, F.lit("Dataset must have at least 10 rows."))
           .when(F.lit(ncols) < MIN_COLS, F.lit("Dataset must have at least 2 columns."))
           .when(F.lit(not has_target), F.lit(f"Target column '{target}' not found."))
           .otherwise(F.lit("Data validation passed.")))
    return n.select((msg == F.lit("Data validation passed.")).alias("valid"), msg.alias("message"))


def drop_missing(df: DataFrame, strategy: str = "drop_columns",
                 threshold: float = MISSING_DROP_FRACTION) -> DataFrame:
    """Drop columns with missing share > threshold, then rows with any null.

    The column list comes from one aggregation (a bounded parameter: one
    number per column); rows are then filtered lazily.
    """
    if strategy == "drop_columns":
        s = summary(df).where(F.try_divide(F.col("missing"), F.col("n_rows")) > threshold).select("column_name")
        drop = [r["column_name"] for r in s.collect()]
        df = df.drop(*drop)
    cond = None
    for f in df.schema.fields:
        m = _missing(f.name, f.dataType)
        cond = m if cond is None else (cond | m)
    return df if cond is None else df.where(~cond)


def numeric_info(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Missing, mean, median, sample std, min, max, distinct per numeric column.

    Exact by default; ``approx=True`` uses ``percentile_approx`` and HLL counts.
    """
    cols = list(cols) if cols else numeric_columns(df)
    base = _with_distinct(df, {
        "missing": lambda c, dt: F.count(F.when(_missing(c, dt), 1)),
        "mean": lambda c, dt: F.avg(F.col(c).cast("double")),
        "std": lambda c, dt: F.stddev_samp(F.col(c).cast("double")),
        "min": lambda c, dt: F.min(F.col(c).cast("double")),
        "max": lambda c, dt: F.max(F.col(c).cast("double"))}, "unique_count", approx, cols)
    if approx:
        med = (melt_numeric(df, cols).groupBy("column_name")
               .agg(F.percentile_approx("value", 0.5, 10000).alias("median")))
    else:
        med = exact_median(melt_numeric(df, cols), "value", ["column_name"], "median")
    return base.join(med, "column_name", "left")


def melt_numeric(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``[keep.., column, value DOUBLE]`` for the given numeric columns."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                    for c in cols])
    return df.select(*keep, F.inline(arr))


def melt_strings(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                    for c in cols])
    return df.select(*keep, F.inline(arr))


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Distinct count and top-k values per categorical column."""
    cols = list(cols) if cols else categorical_columns(df)
    counts = (melt_strings(df, cols).where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))
    top = top_k(counts, ["column_name"], [F.col("count").desc(), F.col("value").asc()], k, "value")
    nu = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    return top.join(nu, "column_name", "inner")


# fixed values: reason texts of the target ranking bands
REASON_BINARY = "✅ Binary (%d classes)"
REASON_LOW = "✅ Low cardinality (%d classes)"
REASON_MEDIUM = "⚠️ Medium cardinality (%d classes)"
REASON_HIGH = "❌ High cardinality (%d classes) - likely a feature"


def _bands(n):
    rank = (F.when(n == 2, 1).when(n <= 20, 2).when(n <= 50, 3).otherwise(4))
    n = n.cast("int")
    reason = (F.when(n == 2, F.format_string(REASON_BINARY, n))
              .when(n <= 20, F.format_string(REASON_LOW, n))
              .when(n <= 50, F.format_string(REASON_MEDIUM, n))
              .otherwise(F.format_string(REASON_HIGH, n)))
    return rank, reason


def rank_targets(df: DataFrame, approx: bool = False) -> DataFrame:
    """Target candidates ranked 1..4 by distinct count; constants skipped."""
    u = _with_distinct(df, {"non_null": lambda c, dt: F.count(F.col(c))}, "unique_count", approx)
    n = F.col("unique_count")
    rank, reason = _bands(n)
    return (u.where(n >= 2)
            .select("column_name", rank.alias("rank"), reason.alias("reason"),
                    n.cast("long").alias("unique_count")))


def suggest_targets(df: DataFrame) -> DataFrame:
    """Rank <= 2 candidates; the first by (rank, name) is the default."""
    r = rank_targets(df).where("rank <= 2")
    w = Window.orderBy("rank", "column_name")  # at most one row per column
    return r.withColumn("is_default", F.row_number().over(w) == 1)


def column_profiles(df: DataFrame, approx: bool = False) -> DataFrame:
    """n, nunique, missing, unique ratio, kind, id-likeness, discreteness."""
    s = _with_distinct(df, {"missing": lambda c, dt: F.count(F.when(F.col(c).isNull(), 1))}, "nunique", approx, with_rows=True)
    p = s.withColumnRenamed("n_rows", "n")
    ratio = F.when(F.col("n") > 0, F.col("nunique") / F.col("n")).otherwise(F.lit(0.0))
    lname = F.lower(F.col("column_name"))
    id_name = F.lit(False)
    for tok in ID_NAME_TOKENS:
        id_name = id_name | lname.contains(tok)
    like_id = ((ratio >= 0.90) & (F.col("nunique") >= 50)) | (id_name & (ratio >= 0.70))
    return p.select("column_name", "ordinal", F.col("kind").alias("dtype_kind"), "n",
                    F.col("nunique").cast("long").alias("nunique"),
                    F.col("missing").cast("long").alias("missing"),
                    ratio.alias("unique_ratio"), like_id.alias("looks_like_id"),
                    ((F.col("kind") == "numeric") & (F.col("nunique") <= DISCRETE_MAX_UNIQUE))
                    .alias("numeric_discrete"))


def view_choice(df: DataFrame, target: str | None = None, top_n: int = 20) -> DataFrame:
    """Chart type per column: none / time_series / bar_counts / histogram /
    topn_bar / grouped_bar / bar (G10)."""
    p = column_profiles(df)
    has_t = target is not None and target in df.columns
    k = F.col("dtype_kind")
    view = (F.when(F.col("looks_like_id"), "none")
            .when(k == "datetime", "time_series")
            .when(F.col("numeric_discrete"), "bar_counts")
            .when(k == "numeric", "histogram")
            .when((k == "categorical") & (F.col("nunique") > top_n), "topn_bar")
            .when((k == "categorical") & F.lit(has_t) & (F.col("column_name") != F.lit(target or "")),
                  "grouped_bar")
            .when(k == "categorical", "bar")
            .otherwise("none"))
    return p.select("column_name", view.alias("view_type"))


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    """Events per day with empty days as 0."""
    d = df.where(F.col(ts).isNotNull()).select(F.date_trunc("day", F.col(ts)).alias("day"))
    counts = d.groupBy("day").agg(F.count(F.lit(1)).alias("count"))
    span = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("count", F.lit(0)).alias("count"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, null kept as its own group."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, col: str, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] (G13; with ``by`` = target: G14)."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    j = attach(df.where(x.isNotNull()).select(*by, x.alias("x")), rng)
    w = (F.col("hi") - F.col("lo")) / bins
    b = F.when(w > 0, F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1))).otherwise(0)
    g = j.select(*by, b.cast("int").alias("bin"), "lo", "hi")
    return (g.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"),
                                      F.first("hi").alias("hi"))
            .select(*by, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins)
                    .alias("bin_start"), "count"))


def top_n_other(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Top-n values by count plus one 'Other' row for the rest."""
    vc = value_counts(df, col).withColumn("value", F.col("value").cast("string"))
    top = top_k(vc, [], [F.col("count").desc(), F.col("value").asc_nulls_last()], n, "value")
    other = (vc.join(top.select("value"), vc["value"].eqNullSafe(top["value"]), "left_anti")
             .agg(F.sum("count").alias("count")).where(F.col("count") > 0)
             .select(F.lit("Other").alias("value"), "count"))
    return top.select("value", "count").unionByName(other)


def crosstab(df: DataFrame, col: str, target: str) -> DataFrame:
    """Category x target counts, rows with a null key dropped."""
    return (df.where(F.col(col).isNotNull() & F.col(target).isNotNull())
            .groupBy(F.col(col).alias("value"), F.col(target).alias("target"))
            .agg(F.count(F.lit(1)).alias("count")))


def preview(df: DataFrame, col: str, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` non-null values of a column in key order, as text."""
    return top_k(df.where(F.col(col).isNotNull()), [], [F.col(key).asc()], n, key).select(
        F.lit(col).alias("column_name"), "rank", F.col(col).cast("string").alias("value"))
