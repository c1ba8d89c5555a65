"""Profiling (P*, G*) queries over ``features_missing``, ``customer``, ``lineitem``, ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import profile as G
from arbiter.operators import sketches as K
from arbiter.plans.frames import FEATURES_CTE, features_missing
from arbiter.plans.registry import query
from arbiter.plans.util import with_ctes
from arbiter.session import scratch_path
from arbiter.sources.tables import load

# (column, ordinal, spark type, kind) of features_missing
FM_COLS = [("id", 0, "bigint", "numeric"), ("o_totalprice", 1, "double", "numeric"),
           ("c_acctbal", 2, "double", "numeric"), ("o_custkey", 3, "double", "numeric"),
           ("c_mktsegment", 4, "string", "categorical"), ("o_orderstatus", 5, "string", "categorical"),
           ("y", 6, "int", "numeric")]


def _union(template: str, cols=FM_COLS, table: str = "features_missing") -> str:
    parts = []
    for c, i, dt, k in cols:
        nullcheck = f"({c} IS NULL OR isnan(CAST({c} AS DOUBLE)))" if k == "numeric" else f"{c} IS NULL"
        parts.append(template.format(c=c, i=i, dt=dt, k=k, miss=nullcheck, t=table))
    return "\nUNION ALL\n".join(parts)


@query("profile_column_types", with_ctes(FEATURES_CTE, _union(
    "SELECT '{c}' AS column_name, {i} AS ordinal, '{dt}' AS dtype, '{k}' AS kind, "
    "CAST(count(*) FILTER (WHERE NOT {miss}) AS BIGINT) AS non_null FROM {t}")))
def profile_column_types(spark, sf):
    """Column kinds and non-null counts."""
    return G.column_types(features_missing(spark, sf))


@query("profile_summary", with_ctes(FEATURES_CTE, "SELECT *, round(missing / n_rows * 100, 2) AS missing_pct FROM (" + _union(
    "SELECT '{c}' AS column_name, {i} AS ordinal, '{dt}' AS dtype, '{k}' AS kind, "
    "CAST(count(*) AS BIGINT) AS n_rows, 7 AS n_columns, "
    "CAST(count(*) FILTER (WHERE {miss}) AS BIGINT) AS missing FROM {t}") + ")"),
       doubles=("missing_pct",))
def profile_summary(spark, sf):
    """G1: missing count and % per column."""
    return G.summary(features_missing(spark, sf))


@query("profile_total_missing", with_ctes(FEATURES_CTE, "SELECT CAST(sum(m) AS BIGINT) AS total_missing FROM (" + _union(
    "SELECT count(*) FILTER (WHERE {miss}) AS m FROM {t}") + ")"))
def profile_total_missing(spark, sf):
    """Total missing cells."""
    return G.total_missing(features_missing(spark, sf))


@query("profile_schema", with_ctes(FEATURES_CTE, _union(
    "SELECT '{c}' AS column_name, {i} AS ordinal, '{dt}' AS dtype, '{k}' AS kind, "
    "CAST(count(*) FILTER (WHERE {miss}) AS BIGINT) AS missing, "
    "CAST(count(DISTINCT {c}) AS BIGINT) AS unique FROM {t}")))
def profile_schema(spark, sf):
    """Type, missing and distinct count per column."""
    return G.schema_table(features_missing(spark, sf))


@query("validate_table", with_ctes(FEATURES_CTE, """
SELECT n >= 10 AS valid,
       CASE WHEN n = 0 THEN 'Dataset is empty.' WHEN n < 10 THEN 'Dataset must have at least 10 rows.'
            ELSE 'Data validation passed.' END AS message
FROM (SELECT count(*) AS n FROM (SELECT 1 FROM features_missing LIMIT 10))"""))
def validate_table(spark, sf):
    """Validation outcome."""
    return G.validate(features_missing(spark, sf), "y")


@query("clean_drop_columns", with_ctes(FEATURES_CTE, """
SELECT id, o_totalprice, o_custkey, c_mktsegment, o_orderstatus, y FROM features_missing
WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) AND c_mktsegment IS NOT NULL"""),
       doubles=("o_totalprice", "o_custkey"))
def clean_drop_columns(spark, sf):
    """Drop columns with > 50 % missing (c_acctbal), then rows with any null."""
    return G.drop_missing(features_missing(spark, sf), "drop_columns")


@query("clean_drop_rows", with_ctes(FEATURES_CTE, """
SELECT * FROM features_missing
WHERE o_totalprice IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL"""),
       doubles=("o_totalprice", "c_acctbal", "o_custkey"))
def clean_drop_rows(spark, sf):
    """P5: drop rows with any null."""
    return G.drop_missing(features_missing(spark, sf), "drop_rows")


@query("preview_head", with_ctes(FEATURES_CTE, "SELECT * FROM features_missing ORDER BY id LIMIT 10"),
       doubles=("o_totalprice", "c_acctbal", "o_custkey"))
def preview_head(spark, sf):
    """First 10 rows by key (the limit is the feature)."""
    return features_missing(spark, sf).orderBy("id").limit(10)


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, {i} AS ordinal, 'double' AS dtype, 'numeric' AS kind,
       CAST(count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS BIGINT) AS missing,
       avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
       CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, quantile_cont({c}, 0.5) AS median
FROM lineitem""" for i, c in enumerate(LI_NUM)), doubles=("mean", "std", "min", "max", "median"))
def profile_numeric(spark, sf):
    """Numeric column info over lineitem (exact median)."""
    li = load(spark, sf, "lineitem").select(*LI_NUM)
    return G.numeric_info(li)


@query("profile_top_values", """
WITH counts AS (
  SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS count FROM customer
  WHERE c_mktsegment IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'c_name', c_name, count(*) FROM customer WHERE c_name IS NOT NULL GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC) AS rank,
             count(*) OVER (PARTITION BY column_name) AS unique_count FROM counts)
SELECT column_name, value, CAST(count AS BIGINT) AS count, CAST(rank AS INTEGER) AS rank,
       CAST(unique_count AS BIGINT) AS unique_count FROM r WHERE rank <= 5""")
def profile_top_values(spark, sf):
    """Top-5 values and distinct count per categorical column of customer."""
    c = load(spark, sf, "customer").select("c_mktsegment", "c_name")
    return G.top_values(c)


_RANK_SQL = _union("SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM {t}")
_RANK_BODY = f"""
SELECT column_name,
       CASE WHEN unique_count = 2 THEN 1 WHEN unique_count <= 20 THEN 2
            WHEN unique_count <= 50 THEN 3 ELSE 4 END AS rank,
       CASE WHEN unique_count = 2 THEN printf('{G.REASON_BINARY}', unique_count)
            WHEN unique_count <= 20 THEN printf('{G.REASON_LOW}', unique_count)
            WHEN unique_count <= 50 THEN printf('{G.REASON_MEDIUM}', unique_count)
            ELSE printf('{G.REASON_HIGH}', unique_count) END AS reason,
       unique_count
FROM ({_RANK_SQL}) WHERE unique_count >= 2"""


@query("profile_rank_targets", with_ctes(FEATURES_CTE, _RANK_BODY))
def profile_rank_targets(spark, sf):
    """Target candidates ranked by distinct count."""
    return G.rank_targets(features_missing(spark, sf))


@query("profile_suggest_targets", with_ctes(FEATURES_CTE, f"""
SELECT *, row_number() OVER (ORDER BY rank, column_name) = 1 AS is_default
FROM ({_RANK_BODY}) WHERE rank <= 2"""))
def profile_suggest_targets(spark, sf):
    """Suggested targets and the default one."""
    return G.suggest_targets(features_missing(spark, sf))


_PROF_SQL = "SELECT *, CASE WHEN n > 0 THEN nunique / n ELSE 0.0 END AS unique_ratio FROM (" + _union(
    "SELECT '{c}' AS column_name, {i} AS ordinal, '{k}' AS dtype_kind, CAST(count(*) AS BIGINT) AS n, "
    "CAST(count(DISTINCT {c}) AS BIGINT) AS nunique, "
    "CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing FROM {t}") + ")"
_PROF_BODY = f"""
SELECT column_name, ordinal, dtype_kind, n, nunique, missing, unique_ratio,
       (unique_ratio >= 0.90 AND nunique >= 50)
         OR ((lower(column_name) LIKE '%id%' OR lower(column_name) LIKE '%uuid%' OR lower(column_name) LIKE '%guid%'
              OR lower(column_name) LIKE '%key%') AND unique_ratio >= 0.70) AS looks_like_id,
       dtype_kind = 'numeric' AND nunique <= 15 AS numeric_discrete
FROM ({_PROF_SQL})"""


@query("profile_columns", with_ctes(FEATURES_CTE, _PROF_BODY), doubles=("unique_ratio",))
def profile_columns(spark, sf):
    """Column profile with id-likeness."""
    return G.column_profiles(features_missing(spark, sf))


@query("view_choice", with_ctes(FEATURES_CTE, f"""
SELECT column_name, CASE WHEN looks_like_id THEN 'none' WHEN dtype_kind = 'datetime' THEN 'time_series'
                    WHEN numeric_discrete THEN 'bar_counts' WHEN dtype_kind = 'numeric' THEN 'histogram'
                    WHEN dtype_kind = 'categorical' AND nunique > 20 THEN 'topn_bar'
                    WHEN dtype_kind = 'categorical' AND column_name <> 'y' THEN 'grouped_bar'
                    WHEN dtype_kind = 'categorical' THEN 'bar' ELSE 'none' END AS view_type
FROM ({_PROF_BODY})"""))
def view_choice(spark, sf):
    """Chart type per column (target y)."""
    return G.view_choice(features_missing(spark, sf), "y")


@query("view_daily_counts", """
WITH c AS (SELECT date_trunc('day', ts) AS day, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1),
d AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM c)
SELECT d.day, CAST(coalesce(c.count, 0) AS BIGINT) AS count FROM d LEFT JOIN c USING (day)""")
def view_daily_counts(spark, sf):
    """Events per day, gaps filled with 0."""
    return G.daily_counts(load(spark, sf, "events"), "ts")


@query("view_value_counts", with_ctes(FEATURES_CTE, """
SELECT c_mktsegment AS value, CAST(count(*) AS BIGINT) AS count FROM features_missing GROUP BY 1"""))
def view_value_counts(spark, sf):
    """Value counts with the null group."""
    return G.value_counts(features_missing(spark, sf), "c_mktsegment")


_HIST = """
r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM features_missing),
b AS (SELECT {by} CAST(CASE WHEN (hi - lo) / 20 > 0
                        THEN least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) ELSE 0 END AS INTEGER) AS bin,
             lo, hi
      FROM features_missing, r WHERE o_totalprice IS NOT NULL)"""


@query("view_histogram", with_ctes(FEATURES_CTE + "," + _HIST.format(by=""), """
SELECT bin, min(lo) + bin * (min(hi) - min(lo)) / 20 AS bin_start, CAST(count(*) AS BIGINT) AS count
FROM b GROUP BY bin"""), doubles=("bin_start",))
def view_histogram(spark, sf):
    """20-bin histogram of o_totalprice."""
    return G.histogram(features_missing(spark, sf), "o_totalprice", 20)


@query("view_histogram_by_class", with_ctes(FEATURES_CTE + "," + _HIST.format(by="y,"), """
SELECT y, bin, min(lo) + bin * (min(hi) - min(lo)) / 20 AS bin_start, CAST(count(*) AS BIGINT) AS count
FROM b GROUP BY y, bin"""), doubles=("bin_start",))
def view_histogram_by_class(spark, sf):
    """Histogram split by target."""
    return G.histogram(features_missing(spark, sf), "o_totalprice", 20, ["y"])


@query("view_topn_other", """
WITH vc AS (SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS count FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value ASC NULLS LAST) AS rn FROM vc)
SELECT value, CAST(count AS BIGINT) AS count FROM r WHERE rn <= 20
UNION ALL
SELECT 'Other', CAST(sum(count) AS BIGINT) FROM r WHERE rn > 20 HAVING sum(count) > 0""")
def view_topn_other(spark, sf):
    """Top-20 nations by customers plus Other."""
    return G.top_n_other(load(spark, sf, "customer"), "c_nationkey", 20)


@query("view_crosstab", with_ctes(FEATURES_CTE, """
SELECT c_mktsegment AS value, y AS target, CAST(count(*) AS BIGINT) AS count FROM features_missing
WHERE c_mktsegment IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2"""))
def view_crosstab(spark, sf):
    """Segment x target counts."""
    return G.crosstab(features_missing(spark, sf), "c_mktsegment", "y")


_SK_COLS = ("l_quantity", "l_extendedprice", "l_discount")
_SK_FRACTIONS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@query("profile_quantiles_sketch", "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, f.fraction, CAST(count(*) AS BIGINT) AS n, CASE WHEN f.fraction = 0 THEN min({c})::DOUBLE WHEN f.fraction = 1 THEN max({c})::DOUBLE END AS exact_end, "
    f"true AS within_1_percent FROM lineitem, (VALUES {', '.join(f'({f}::DOUBLE)' for f in _SK_FRACTIONS)}) f(fraction) GROUP BY f.fraction" for c in _SK_COLS) + ")",
    doubles=("fraction", "exact_end"))
def profile_quantiles_sketch(spark, sf):
    """G4 from stored sketches: four parts of the table, one stored twice, merged on read; ranks within 1 % of those asked for."""
    li, path = load(spark, sf, "lineitem"), scratch_path(spark, "sketches")
    part = F.pmod(F.xxhash64("l_orderkey"), F.lit(4))
    for i in (0, 1, 2, 3, 1):
        K.store(K.sketch(li.where(part == i), _SK_COLS), path, str(i))
    merged = K.merge(K.load(spark, path))
    asked = K.quantiles(merged, _SK_FRACTIONS)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in _SK_COLS])
    got = li.select(F.inline(cells)).join(F.broadcast(asked), "feature").groupBy("feature", "fraction").agg(  # 21 rows
        F.count("v").alias("n"), F.avg((F.col("v") < F.col("value")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("value")).cast("double")).alias("upto"),
        F.first("value").alias("value"))
    near = (F.col("below") <= F.col("fraction") + 0.01) & (F.col("upto") >= F.col("fraction") - 0.01)
    return got.select("feature", "fraction", "n", F.when(F.col("fraction").isin(0.0, 1.0), F.col("value")).alias("exact_end"), near.alias("within_1_percent"))
