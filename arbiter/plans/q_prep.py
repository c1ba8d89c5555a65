"""Feature preparation (F*) and data-quality (Q*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.functions.hashing import hash_uniform, sql_hash_uniform
from arbiter.operators import prep as P
from arbiter.operators import quality as Q
from arbiter.operators.common import attach
from arbiter.plans.frames import FEATURES_CTE, QUALITY_CTE, features, features_missing, quality_frame
from arbiter.plans.registry import query
from arbiter.plans.util import with_ctes
from arbiter.sources.tables import load

NUM = ["o_totalprice", "c_acctbal", "o_custkey"]
CAT = ["c_mktsegment", "o_orderstatus"]
QNUM = NUM + ["leaky"]
QFEAT = NUM + CAT + ["leaky"]

_TOKENS = "(" + ", ".join(f"'{t}'" for t in P.POSITIVE_TOKENS) + ")"

_ENC_SQL = """
enc AS (
  SELECT feature, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY label) - 1 AS INTEGER) AS code, label
  FROM (SELECT DISTINCT 'c_mktsegment' AS feature, coalesce(c_mktsegment, 'nan') AS label FROM features_missing
        UNION
        SELECT DISTINCT 'o_orderstatus', coalesce(o_orderstatus, 'nan') FROM features_missing)
)"""


@query("prep_encoder_table", with_ctes(FEATURES_CTE + "," + _ENC_SQL, "SELECT * FROM enc"))
def prep_encoder_table(spark, sf):
    """label encoder table of the categorical features."""
    return P.encoder_table(features_missing(spark, sf), CAT)


@query("feat_category_options", with_ctes(FEATURES_CTE + "," + _ENC_SQL,
                                          "SELECT feature, label AS option, code AS ordinal FROM enc"))
def feat_category_options(spark, sf):
    """categorical options per feature (long form, sorted ordinal)."""
    return P.encoder_table(features_missing(spark, sf), CAT).select(
        "feature", F.col("label").alias("option"), F.col("code").alias("ordinal"))


@query("prep_label_encode", with_ctes(FEATURES_CTE + "," + _ENC_SQL, """
SELECT f.id, a.code AS c_mktsegment, b.code AS o_orderstatus FROM features_missing f
LEFT JOIN enc a ON a.feature = 'c_mktsegment' AND a.label = coalesce(f.c_mktsegment, 'nan')
LEFT JOIN enc b ON b.feature = 'o_orderstatus' AND b.label = coalesce(f.o_orderstatus, 'nan')"""))
def prep_label_encode(spark, sf):
    """categorical columns replaced by their codes."""
    return P.label_encode(features_missing(spark, sf), CAT).select("id", *CAT)


@query("prep_task_type", with_ctes(FEATURES_CTE, """
SELECT 'y' AS target, CASE WHEN count(DISTINCT y) < 20 THEN 'classification' ELSE 'regression' END AS task_type,
       CAST(count(DISTINCT y) AS BIGINT) AS n_unique FROM features
UNION ALL
SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) < 20 THEN 'classification' ELSE 'regression' END,
       CAST(count(DISTINCT o_totalprice) AS BIGINT) FROM features
UNION ALL
SELECT 'o_orderstatus', 'classification', CAST(count(DISTINCT o_orderstatus) AS BIGINT) FROM features"""))
def prep_task_type(spark, sf):
    """task type for three candidate targets."""
    f = features(spark, sf)
    parts = [P.task_type(f, t).select(F.lit(t).alias("target"), "*") for t in ("y", "o_totalprice", "o_orderstatus")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("prep_standardize", with_ctes(FEATURES_CTE, """
SELECT id, """ + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) OVER () END AS {c}" for c in NUM) + " FROM features"),
       doubles=tuple(NUM))
def prep_standardize(spark, sf):
    """numeric features standardised with the population std."""
    return P.standardize(features(spark, sf).select("id", *NUM), NUM)


@query("prep_stratified_split", with_ctes(FEATURES_CTE + """,
s AS (SELECT id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id)
                             <= ceil(count(*) OVER (PARTITION BY y) * CAST(0.2 AS DOUBLE))
                        THEN 'test' ELSE 'train' END AS split FROM features)""", "SELECT * FROM s"))
def prep_stratified_split(spark, sf):
    """deterministic stratified 80/20 split."""
    return P.stratified_split(features(spark, sf).select("id", "y"), "id", "y")


@query("prep_full", with_ctes(FEATURES_CTE + "," + _ENC_SQL.replace("features_missing", "features") + """,
s AS (SELECT f.*, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id)
                             <= ceil(count(*) OVER (PARTITION BY y) * CAST(0.2 AS DOUBLE))
                        THEN 'test' ELSE 'train' END AS split FROM features f),
e AS (SELECT s.id, s.y, s.split, """ + ", ".join(NUM) + """, a.code AS c_mktsegment, b.code AS o_orderstatus
      FROM s LEFT JOIN enc a ON a.feature = 'c_mktsegment' AND a.label = s.c_mktsegment
             LEFT JOIN enc b ON b.feature = 'o_orderstatus' AND b.label = s.o_orderstatus)""", """
SELECT id, y, split, c_mktsegment, o_orderstatus, """ + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) OVER () END AS {c}" for c in NUM) + " FROM e"), doubles=tuple(NUM))
def prep_full(spark, sf):
    """encode, split and standardise (scaler fitted on all rows, as the reference)."""
    out = P.prepare(features(spark, sf), "y", "id", fit_on="all")
    return out.select("id", "y", "split", "c_mktsegment", "o_orderstatus", *NUM)


@query("feat_ranges", with_ctes(FEATURES_CTE, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max FROM features" for c in NUM)),
       doubles=("min", "max"))
def feat_ranges(spark, sf):
    """original-scale ranges."""
    return P.feature_ranges(features(spark, sf), NUM)


@query("feat_stats", with_ctes(FEATURES_CTE, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, "
    f"stddev_samp({c}) AS std FROM features" for c in NUM)), doubles=("min", "max", "mean", "std"))
def feat_stats(spark, sf):
    """F8: min / max / mean / sample std on the original scale."""
    return P.feature_stats(features(spark, sf), NUM)


@query("prep_positive_label", """
WITH v AS (
  SELECT DISTINCT 'quality' AS target, CAST(quality AS VARCHAR) AS value FROM labels
  UNION SELECT DISTINCT 'toxic', CAST(toxic AS VARCHAR) FROM labels
  UNION SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders)
SELECT target,
       CASE WHEN count(*) = 2 THEN coalesce(min(value) FILTER (WHERE lower(value) IN """ + _TOKENS + """), min(value))
            ELSE min(value) END AS positive_label,
       count(*) = 2 AND min(value) FILTER (WHERE lower(value) IN """ + _TOKENS + """) IS NOT NULL AS inferred
FROM v WHERE value IS NOT NULL GROUP BY target""")
def prep_positive_label(spark, sf):
    """inferred positive label of three binary-ish targets."""
    lab = P.positive_label(load(spark, sf, "labels"), ["quality", "toxic"])
    o = P.positive_label(load(spark, sf, "orders"), ["o_orderstatus"])
    return lab.unionByName(o)


@query("prep_encode_target", """
WITH pos AS (
  SELECT coalesce(min(v) FILTER (WHERE lower(v) IN """ + _TOKENS + """), min(v)) AS p
  FROM (SELECT DISTINCT CAST(quality AS VARCHAR) AS v FROM labels WHERE quality IS NOT NULL))
SELECT doc_id, CAST(quality AS VARCHAR) AS target, CAST(CAST(quality AS VARCHAR) = pos.p AS INTEGER) AS y
FROM labels, pos""")
def prep_encode_target(spark, sf):
    """string target encoded 0/1 with the inferred positive label."""
    lab = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("target"))
    return P.encode_target(lab, "target")


def _qf(spark, sf):
    q = quality_frame(spark, sf)
    return q.where("split = 'train'"), q.where("split = 'test'")


_FILL = ", ".join(f"coalesce({c}, avg({c}) OVER (PARTITION BY split)) AS {c}" for c in QNUM)
_QFILL = QUALITY_CTE + f""",
qfill AS (SELECT id, y, split, {_FILL} FROM qf)"""


_CORR_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS correlation_with_target FROM qfill WHERE split = 'train'"
    for c in QNUM)


@query("dq_leakage", with_ctes(_QFILL, f"""
SELECT feature, correlation_with_target,
       CASE WHEN correlation_with_target > 0.9 THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level
FROM ({_CORR_SQL})
WHERE correlation_with_target IS NOT NULL AND NOT isnan(correlation_with_target)
  AND correlation_with_target > 0.8"""), doubles=("correlation_with_target",))
def dq_leakage(spark, sf):
    """Q1: features too correlated with the target on the training rows."""
    tr, _ = _qf(spark, sf)
    return Q.leakage(tr, QNUM)


# one lattice step: a state is [first i, probability outside, probabilities of i, i + 1, ...], x is [diagonal]
_KS_STEP = """list_transform([list_transform(range(1, len(acc)), lambda k:
    CASE WHEN k > 1 THEN acc[k + 1] * (n1 - (acc[1] + k - 2)) / (n1 + n2 - x[1]) ELSE 0.0 END
    + CASE WHEN k + 2 <= len(acc) THEN acc[k + 2] * (n2 - (x[1] - (acc[1] + k - 1))) / (n1 + n2 - x[1]) ELSE 0.0 END)], lambda q:
  list_transform([[greatest(acc[1], floor(((x[1] + 1) * n1 - reach) / (n1 + n2)) + 1),
                   least(acc[1] + len(acc) - 2, ceil(((x[1] + 1) * n1 + reach) / (n1 + n2)) - 1)]], lambda r:
    list_concat([r[1], acc[2] + coalesce(list_sum(list_filter(q, lambda v, k: acc[1] + k - 1 < r[1] OR acc[1] + k - 1 > r[2])), 0.0)],
                list_filter(q, lambda v, k: acc[1] + k - 1 BETWEEN r[1] AND r[2])))[1])[1]"""


def _ks_p_sql(keys: str) -> str:
    """From ``cum``: D, and its p-value by counted lattice paths up to 10,000 rows a side, by the series beyond."""
    return f"""
ks AS (SELECT {keys}, max(abs(cum_a / tot_a - cum_b / tot_b)) AS d, CAST(max(tot_a) AS BIGINT) AS n1, CAST(max(tot_b) AS BIGINT) AS n2 FROM cum GROUP BY {keys}),
ksl AS (SELECT *, d * sqrt(n1 * n2 / (n1 + n2)) AS lam, round(d * (n1 // gcd(n1, n2)) * n2) * gcd(n1, n2) AS reach FROM ks),
kse AS (SELECT {keys}, CASE WHEN reach = 0 THEN 1.0 ELSE least(1.0, list_reduce(
          list_concat([[0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE]], list_transform(range(n1 + n2), lambda s: [CAST(s AS DOUBLE)])),
          lambda acc, x: {_KS_STEP})[2]) END AS p_value
        FROM ksl WHERE greatest(n1, n2) <= {Q.EXACT_KS}),
ksa AS (SELECT {keys}, least(greatest(
          CASE WHEN lam < 1e-3 THEN 1.0
               WHEN lam < 1.18 THEN 1 - sqrt(2 * pi()) / lam * list_sum(list_transform(range(1, 101),
                 lambda k: exp(-((2 * k - 1) * (2 * k - 1)) * pi() * pi() / (8 * lam * lam))))
               ELSE 2 * list_sum(list_transform(range(1, 101),
                 lambda k: power(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam))) END, 0.0), 1.0) AS p_value
        FROM ksl WHERE greatest(n1, n2) > {Q.EXACT_KS}),
ksp AS (SELECT *, ks.d AS ks_statistic FROM (SELECT * FROM kse UNION ALL SELECT * FROM ksa) JOIN ks USING ({keys})),"""


_KS_SQL = _QFILL + """,
melt AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {c} AS value, split FROM qfill" for c in QNUM) + """),
cnt AS (SELECT feature, value, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a,
               sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS b FROM melt GROUP BY feature, value),
cum AS (SELECT *, sum(a) OVER (PARTITION BY feature ORDER BY value) AS cum_a,
                  sum(b) OVER (PARTITION BY feature ORDER BY value) AS cum_b,
                  sum(a) OVER (PARTITION BY feature) AS tot_a, sum(b) OVER (PARTITION BY feature) AS tot_b
        FROM cnt),
""" + _ks_p_sql("feature") + """
mst AS (SELECT feature, avg(value) FILTER (WHERE split = 'train') AS train_mean,
               avg(value) FILTER (WHERE split = 'test') AS test_mean,
               stddev_samp(value) FILTER (WHERE split = 'train') AS train_std,
               stddev_samp(value) FILTER (WHERE split = 'test') AS test_std FROM melt GROUP BY feature),
drift AS (SELECT ksp.feature, ks_statistic, p_value, train_mean, test_mean, train_std, test_std,
                 p_value < 0.05 AS drifted FROM ksp JOIN mst USING (feature))"""


@query("dq_drift_ks", with_ctes(_KS_SQL, "SELECT * FROM drift"),
       doubles=("ks_statistic", "p_value", "train_mean", "test_mean", "train_std", "test_std"))
def dq_drift_ks(spark, sf):
    """Q2: two-sample KS drift between train and test per numeric feature."""
    tr, te = _qf(spark, sf)
    return Q.drift(tr, te, QNUM)


_SCOPE_SQL = FEATURES_CTE + f""",
sf AS (SELECT unnest(['all', o_orderstatus]) AS scope, id, o_totalprice, c_acctbal, o_custkey,
              {sql_hash_uniform("CAST(id AS VARCHAR) || ':drift'")} < CAST(0.2 AS DOUBLE) AS is_test FROM features_missing),
melt AS (""" + "\nUNION ALL\n".join(
    f"SELECT scope, is_test, '{c}' AS feature, coalesce({c}, avg({c}) OVER (PARTITION BY scope, is_test)) AS value FROM sf"
    for c in ("o_totalprice", "c_acctbal", "o_custkey")) + """),
cnt AS (SELECT scope, feature, value, count(*) FILTER (WHERE NOT is_test) AS a, count(*) FILTER (WHERE is_test) AS b
        FROM melt GROUP BY scope, feature, value),
cum AS (SELECT *, sum(a) OVER (PARTITION BY scope, feature ORDER BY value) AS cum_a, sum(b) OVER (PARTITION BY scope, feature ORDER BY value) AS cum_b,
                  sum(a) OVER (PARTITION BY scope, feature) AS tot_a, sum(b) OVER (PARTITION BY scope, feature) AS tot_b FROM cnt),
""" + _ks_p_sql("scope, feature") + """
mst AS (SELECT scope, feature, avg(value) FILTER (WHERE NOT is_test) AS train_mean, avg(value) FILTER (WHERE is_test) AS test_mean,
               stddev_samp(value) FILTER (WHERE NOT is_test) AS train_std, stddev_samp(value) FILTER (WHERE is_test) AS test_std
        FROM melt GROUP BY scope, feature)"""


@query("dq_drift_ks_scopes", with_ctes(_SCOPE_SQL, """
SELECT scope, feature, ks_statistic, p_value, train_mean, test_mean, train_std, test_std, p_value < 0.05 AS drifted
FROM ksp JOIN mst USING (scope, feature)"""),
       doubles=("ks_statistic", "p_value", "train_mean", "test_mean", "train_std", "test_std"))
def dq_drift_ks_scopes(spark, sf):
    """Q2 for all orders and for each order status: small scopes have exact p-values, large ones asymptotic."""
    f = features_missing(spark, sf).withColumn("scope", F.explode(F.array(F.lit("all"), F.col("o_orderstatus"))))
    is_test = hash_uniform(F.col("id"), "drift") < 0.2
    return Q.drift(f.where(~is_test), f.where(is_test), ["o_totalprice", "c_acctbal", "o_custkey"], by=["scope"])


@query("dq_class_imbalance", with_ctes(QUALITY_CTE, """
SELECT class, count, imbalance_ratio,
       CASE WHEN imbalance_ratio < 2 THEN 'Low' WHEN imbalance_ratio < 5 THEN 'Medium' ELSE 'High' END AS severity
FROM (SELECT y AS class, CAST(count(*) AS BIGINT) AS count FROM qf WHERE split = 'train' GROUP BY y) c,
     (SELECT max(n) / min(n) AS imbalance_ratio FROM
        (SELECT count(*) AS n FROM qf WHERE split = 'train' GROUP BY y)) r"""), doubles=("imbalance_ratio",))
def dq_class_imbalance(spark, sf):
    """Q3: class balance of the training target."""
    tr, _ = _qf(spark, sf)
    return Q.class_imbalance(tr)


_MISS_SQL = QUALITY_CTE + """,
mf AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE {c} IS NULL"
    + (f" OR isnan({c})" if c in QNUM else "") + f") AS BIGINT) AS missing_count, count(*) AS n_rows "
    f"FROM qf WHERE split = 'train'" for c in QFEAT) + "),"
_MISS_SQL += """
ms AS (SELECT feature, missing_count, missing_count / n_rows * 100 AS missing_percentage,
              CASE WHEN missing_count / n_rows * 100 > 50 THEN 'High'
                   WHEN missing_count / n_rows * 100 > 10 THEN 'Medium' ELSE 'Low' END AS severity,
              sum(missing_count) OVER () / (max(n_rows) OVER () * """ + str(len(QFEAT)) + """) * 100
                AS total_missing_percentage
       FROM mf)"""


@query("dq_missing", with_ctes(_MISS_SQL, "SELECT * FROM ms WHERE missing_count > 0"),
       doubles=("missing_percentage", "total_missing_percentage"))
def dq_missing(spark, sf):
    """Q4: missing values per training feature and the total share."""
    tr, _ = _qf(spark, sf)
    return Q.missing(tr.select(*QFEAT))


_OUT_SQL = QUALITY_CTE + """,
os AS (""" + "\nUNION ALL\n".join(f"""
  SELECT '{c}' AS feature, CAST(sum(CASE WHEN abs(coalesce(q.{c}, s.m) - s.m)
           / sqrt(s.v * (s.k - 1) / (s.n - 1)) > 3 THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count,
         count(*) AS n
  FROM qf q, (SELECT avg({c}) AS m, var_samp({c}) AS v, count({c}) AS k, count(*) AS n
              FROM qf WHERE split = 'train') s
  WHERE q.split = 'train'""" for c in QNUM) + ")"


@query("dq_outliers", with_ctes(_OUT_SQL, """
SELECT feature, outlier_count, outlier_count / n * 100 AS outlier_percentage FROM os WHERE outlier_count > 0"""),
       doubles=("outlier_percentage",))
def dq_outliers(spark, sf):
    """Q5: z-score outliers (> 3) per training feature."""
    tr, _ = _qf(spark, sf)
    return Q.outliers(tr, QNUM)


_REPORT_SQL = _KS_SQL.replace("WITH", "") + """,
lk AS (SELECT count(*) AS leakage_findings FROM (""" + "\nUNION ALL\n".join(
    f"SELECT abs(corr({c}, y)) AS r FROM qfill WHERE split = 'train'" for c in QNUM) + """)
       WHERE r IS NOT NULL AND NOT isnan(r) AND r > 0.8),
""" + _OUT_SQL.split(QUALITY_CTE + ",")[1] + """,
ou AS (SELECT count(*) AS outlier_findings FROM os WHERE outlier_count > 0),
im AS (SELECT CASE WHEN max(n) / min(n) < 2 THEN 'Low' WHEN max(n) / min(n) < 5 THEN 'Medium' ELSE 'High' END
              AS imbalance_severity FROM (SELECT count(*) AS n FROM qf WHERE split = 'train' GROUP BY y)),
mm AS (SELECT split, sum(m) / (max(n) * """ + str(len(QFEAT)) + """) * 100 AS pct FROM (""" + "\nUNION ALL\n".join(
    f"SELECT split, count(*) FILTER (WHERE {c} IS NULL" + (f" OR isnan({c})" if c in QNUM else "")
    + ") AS m, count(*) AS n FROM qf GROUP BY split" for c in QFEAT) + """) GROUP BY split),
rep AS (
  SELECT CAST(lk.leakage_findings AS BIGINT) AS leakage_findings,
         CAST((SELECT count(*) FROM drift WHERE drifted) AS BIGINT) AS drift_findings,
         CAST(ou.outlier_findings AS BIGINT) AS outlier_findings, im.imbalance_severity,
         (SELECT pct FROM mm WHERE split = 'train') AS train_missing_percentage,
         (SELECT pct FROM mm WHERE split = 'test') AS test_missing_percentage
  FROM lk, ou, im),
rep2 AS (
  SELECT *, CAST(greatest(0, 100 - (leakage_findings + drift_findings + outlier_findings) * 10) AS DOUBLE)
              AS quality_score FROM rep)"""

_REPORT_BODY = f"""
SELECT leakage_findings, drift_findings, outlier_findings, imbalance_severity, train_missing_percentage,
       quality_score,
       CASE WHEN quality_score > 75 THEN 'green' WHEN quality_score > 50 THEN 'yellow' ELSE 'red' END AS score_band,
       concat_ws(chr(10),
         CASE WHEN leakage_findings > 0 THEN '{Q.REC_LEAK}' ELSE '{Q.REC_LEAK_OK}' END,
         CASE WHEN drift_findings > 0 THEN '{Q.REC_DRIFT}' ELSE '{Q.REC_DRIFT_OK}' END,
         CASE WHEN imbalance_severity = 'High' THEN '{Q.REC_IMB}' ELSE '{Q.REC_IMB_OK}' END,
         CASE WHEN train_missing_percentage > 5 THEN '{Q.REC_MISS}' ELSE '{Q.REC_MISS_OK}' END,
         CASE WHEN test_missing_percentage > 5 THEN '{Q.REC_MISS}' ELSE '{Q.REC_MISS_OK}' END,
         CASE WHEN outlier_findings > 0 THEN '{Q.REC_OUT}' ELSE '{Q.REC_OUT_OK}' END) AS warnings
FROM rep2"""


@query("dq_report", "WITH " + _REPORT_SQL.strip() + _REPORT_BODY,
       doubles=("train_missing_percentage", "quality_score"))
def dq_report(spark, sf):
    """Q6/Q8: quality score, band and recommendations."""
    tr, te = _qf(spark, sf)
    return Q.report(tr.drop("id", "split"), te.drop("id", "split"), QNUM)


@query("dq_summary", "WITH " + _REPORT_SQL.strip() + f""",
iss AS (SELECT quality_score, concat_ws(chr(10),
          CASE WHEN leakage_findings > 0 THEN '{Q.ISSUE_LEAK}' END,
          CASE WHEN drift_findings > 0 THEN '{Q.ISSUE_DRIFT}' END,
          CASE WHEN imbalance_severity = 'High' THEN '{Q.ISSUE_IMB}' END,
          CASE WHEN train_missing_percentage > 5 THEN '{Q.ISSUE_MISS}' END) AS issues FROM rep2)
SELECT quality_score,
       CASE WHEN issues = '' THEN '✅ Data quality looks good (Score: ' || printf('%.0f', quality_score) || '/100)'
            ELSE '⚠️ Data quality issues found (Score: ' || printf('%.0f', quality_score) || '/100):' || chr(10) || issues
       END AS summary
FROM iss""", doubles=("quality_score",))
def dq_summary(spark, sf):
    """Q7: one-paragraph quality summary."""
    tr, te = _qf(spark, sf)
    return Q.summary(Q.report(tr.drop("id", "split"), te.drop("id", "split"), QNUM))


@query("prep_split_nulls", """
WITH f AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey END AS id,
                  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderstatus = 'F' AS INTEGER) END AS y FROM orders)
SELECT y, CAST(count(*) AS BIGINT) AS n, CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_test FROM f GROUP BY y""")
def prep_split_nulls(spark, sf):
    """F6 on null keys and labels: every row is dealt out, null labels are a class of their own."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    f = o.select(F.when(k % 10 != 0, k).alias("id"), F.when(k % 5 != 0, (F.col("o_orderstatus") == "F").cast("int")).alias("y"))
    return P.stratified_split(f, "id", "y").groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("split") == "test", 1)).alias("n_test"))


@query("dq_report_constant", """
SELECT CAST(0 AS BIGINT) AS leakage_findings, CAST(0 AS BIGINT) AS drift_findings, CAST(0 AS BIGINT) AS outlier_findings,
       100.0::DOUBLE AS quality_score, 'green' AS score_band, CAST(count(*) AS BIGINT) AS n FROM orders""", doubles=("quality_score",))
def dq_report_constant(spark, sf):
    """Q6 on a table whose only feature is constant: no finding, no error."""
    o = load(spark, sf, "orders").select(F.lit(1.0).alias("k"), (F.col("o_orderkey") % 2).cast("int").alias("y"))
    r = Q.report(o, o, ["k"]).select("leakage_findings", "drift_findings", "outlier_findings", "quality_score", "score_band")
    return attach(r, o.agg(F.count(F.lit(1)).alias("n")))


@query("prep_factorize", """
WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS v FROM orders),
c AS (SELECT v, row_number() OVER (ORDER BY min(id)) - 1 AS code FROM f WHERE v IS NOT NULL GROUP BY v)
SELECT f.id, f.v, CAST(coalesce(c.code, -1) AS INTEGER) AS code FROM f LEFT JOIN c USING (v)""")
def prep_factorize(spark, sf):
    """Codes in the order of first appearance; null is -1."""
    k = F.col("o_orderkey")
    f = load(spark, sf, "orders").select(k.alias("id"), F.when(k % 6 != 0, F.col("o_orderpriority")).alias("v"))
    return P.factorize(f, "v", "id")


@query("prep_yes_no", """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN CAST(o_custkey % 100 AS INTEGER) + 7 END AS flag FROM orders""")
def prep_yes_no(spark, sf):
    """Yes / No as 1 / 0; numbers stay, other words and nulls are null."""
    k = F.col("o_orderkey") % 5
    word = F.when(k == 0, F.lit("Yes")).when(k == 1, F.lit("No")).when(k == 2, (F.col("o_custkey") % 100 + 7).cast("string")).when(k == 3, F.lit("maybe"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), P.yes_no(word).alias("flag"))
