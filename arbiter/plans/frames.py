"""Derived frames shared by the registered queries.

Each Spark frame has a DuckDB twin (``*_CTE``) computing the same rows from
the same parquet tables, so every query can be checked against plain SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.functions.hashing import hash_uniform, sql_hash_uniform
from arbiter.operators import prep as P
from arbiter.operators.common import literal_row, materialize
from arbiter.sources.tables import load

# fixed values of the bindings (see SURVEY 7.2)
POSITIVE_PRIORITIES = ("1-URGENT", "2-HIGH")
SPLIT_SEED = 42


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def p_a(price: Column) -> Column:
    return _sigmoid((price.cast("double") - F.lit(250000.0)) / F.lit(100000.0))


def p_b(custkey: Column) -> Column:
    return _sigmoid(((custkey % 1000).cast("double") - F.lit(500.0)) / F.lit(200.0))


def orders_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide frame: ``[id, y, y_signal, p_a, p_b]`` (one row per order)."""
    o = load(spark, sf_dir, "orders")
    pa = p_a(F.col("o_totalprice"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").isin(*POSITIVE_PRIORITIES).cast("int").alias("y"),
        (pa > hash_uniform(F.col("o_orderkey"))).cast("int").alias("y_signal"),
        pa.alias("p_a"),
        p_b(F.col("o_custkey")).alias("p_b"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("ts"))


def scored(spark: SparkSession, sf_dir: str, label: str = "y", extra=()) -> DataFrame:
    """Long frame ``[id, model, y, p]``: two fixed scorers over ``orders``."""
    w = orders_scores(spark, sf_dir)
    return w.select("id", F.col(label).alias("y"), *extra,
                    F.expr("stack(2, 'model_a', p_a, 'model_b', p_b) AS (model, p)")) \
        .select("id", "model", "y", "p", *extra)


def decided(spark: SparkSession, sf_dir: str, threshold: float = 0.5,
            label: str = "y", extra=()) -> DataFrame:
    """``scored`` plus ``pred = p >= threshold``."""
    return scored(spark, sf_dir, label, extra).withColumn(
        "pred", (F.col("p") >= F.lit(float(threshold))).cast("int"))


ORDERS_SCORES_CTE = f"""
orders_scores AS (
  SELECT o_orderkey AS id,
         CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS y,
         CAST((1.0 / (1.0 + exp(-((CAST(o_totalprice AS DOUBLE) - 250000.0) / 100000.0))))
              > {sql_hash_uniform("CAST(o_orderkey AS VARCHAR)")} AS INTEGER) AS y_signal,
         1.0 / (1.0 + exp(-((CAST(o_totalprice AS DOUBLE) - 250000.0) / 100000.0))) AS p_a,
         1.0 / (1.0 + exp(-((CAST(o_custkey % 1000 AS DOUBLE) - 500.0) / 200.0))) AS p_b,
         o_orderstatus AS status, o_orderdate AS ts
  FROM orders
)"""


def scored_cte(label: str = "y") -> str:
    return ORDERS_SCORES_CTE + f""",
scored AS (
  SELECT id, 'model_a' AS model, {label} AS y, p_a AS p, status, ts FROM orders_scores
  UNION ALL
  SELECT id, 'model_b' AS model, {label} AS y, p_b AS p, status, ts FROM orders_scores
)"""


def decided_cte(threshold: float = 0.5, label: str = "y") -> str:
    return scored_cte(label) + f""",
decided AS (
  SELECT *, CAST(p >= CAST({threshold!r} AS DOUBLE) AS INTEGER) AS pred FROM scored
)"""


def proba3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``[id, y, prob]``: 3-class softmax of two fixed logits and a zero logit."""
    o = load(spark, sf_dir, "orders")
    e0 = F.exp((F.col("o_totalprice").cast("double") - 250000.0) / 100000.0)
    e1 = F.exp(((F.col("o_custkey") % 1000).cast("double") - 500.0) / 200.0)
    e2 = F.lit(1.0)
    s = e0 + e1 + e2
    y3 = (F.when(F.col("o_orderpriority").isin(*POSITIVE_PRIORITIES), 0)
          .when(F.col("o_orderpriority") == "3-MEDIUM", 1).otherwise(2))
    return o.select(F.col("o_orderkey").alias("id"), y3.alias("y"),
                    F.array(e0 / s, e1 / s, e2 / s).alias("prob"))


PROBA3_CTE = """
proba3 AS (
  SELECT id, y, [e0 / (e0 + e1 + e2), e1 / (e0 + e1 + e2), e2 / (e0 + e1 + e2)] AS prob FROM (
    SELECT o_orderkey AS id,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0
                WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 2 END AS y,
           exp((CAST(o_totalprice AS DOUBLE) - 250000.0) / 100000.0) AS e0,
           exp((CAST(o_custkey % 1000 AS DOUBLE) - 500.0) / 200.0) AS e1,
           1.0 AS e2
    FROM orders))"""


def regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``[id, model, y, pred]``: two fixed regressors of ``o_totalprice``."""
    o = load(spark, sf_dir, "orders")
    y = F.col("o_totalprice").cast("double")
    a = y * 0.9 + 20000.0
    b = 250000.0 + ((F.col("o_custkey") % 1000).cast("double") - 500.0) * 400.0
    return o.select(F.col("o_orderkey").alias("id"), y.alias("y"),
                    F.expr("1").alias("_x"), a.alias("pa"), b.alias("pb")) \
        .select("id", "y", F.expr("stack(2, 'model_a', pa, 'model_b', pb) AS (model, pred)"))


REGRESSED_CTE = """
regressed AS (
  SELECT o_orderkey AS id, 'model_a' AS model, CAST(o_totalprice AS DOUBLE) AS y,
         CAST(o_totalprice AS DOUBLE) * 0.9 + 20000.0 AS pred FROM orders
  UNION ALL
  SELECT o_orderkey AS id, 'model_b' AS model, CAST(o_totalprice AS DOUBLE) AS y,
         250000.0 + (CAST(o_custkey % 1000 AS DOUBLE) - 500.0) * 400.0 AS pred FROM orders
)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders ⋈ customer``: ``[id, o_totalprice, c_acctbal, o_custkey, c_mktsegment,
    o_orderstatus, y]``."""
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("o_totalprice"),
                    F.col("c_acctbal").cast("double").alias("c_acctbal"),
                    F.col("o_custkey").cast("double").alias("o_custkey"),
                    "c_mktsegment", "o_orderstatus",
                    F.col("o_orderpriority").isin(*POSITIVE_PRIORITIES).cast("int").alias("y"))


def features_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features`` with nulls injected by key (about 1/3, 3/4 and 1/5 of rows)."""
    f = features(spark, sf_dir)
    k = F.col("id")
    return f.select("id",
                    F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                    F.when(k % 4 != 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    "o_custkey",
                    F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
                    "o_orderstatus", "y")


FEATURES_CTE = """
features AS (
  SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
         CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(o_custkey AS DOUBLE) AS o_custkey,
         c_mktsegment, o_orderstatus,
         CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey
),
features_missing AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN id % 4 <> 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         o_custkey, CASE WHEN id % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
         o_orderstatus, y
  FROM features
)"""


def quality_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features_missing`` + ``leaky = y + 0.1 (u - 0.5)`` + stratified ``split``."""
    f = features_missing(spark, sf_dir)
    f = f.withColumn("leaky", F.col("y") + 0.1 * (hash_uniform(F.col("id"), "leak") - 0.5))
    # every check reads this frame (train and test sides): cut its lineage once
    return materialize(P.stratified_split(f, "id", "y"))


QUALITY_CTE = FEATURES_CTE + f""",
qf0 AS (
  SELECT *, y + 0.1 * ({sql_hash_uniform("CAST(id AS VARCHAR) || ':leak'")} - 0.5) AS leaky
  FROM features_missing
),
qf AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id)
                      <= ceil(count(*) OVER (PARTITION BY y) * CAST(0.2 AS DOUBLE))
                 THEN 'test' ELSE 'train' END AS split
  FROM qf0
)"""


def features_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features`` with the signal target ``y = p_a(price) > u(id)``."""
    f = features(spark, sf_dir)
    return f.withColumn("y", (p_a(F.col("o_totalprice")) > hash_uniform(F.col("id"))).cast("int"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, split, train-scaled frame: ``[id, y, split, 3 scaled numerics, 2 codes]``."""
    return prep_bundle(spark, sf_dir).prepared


class PrepBundle:
    """Everything the model-space queries share; each part is made once, when it is first used.

    ``split`` (raw columns + split) is materialized in the shared checkpoint
    folder; the scaler statistics and raw ranges are one-row literals
    (bounded parameters); ``prepared`` is a narrow projection on top.
    """

    CATEGORICAL = ("c_mktsegment", "o_orderstatus")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.raw = features_signal(spark, sf_dir)

    @cached_property
    def split(self) -> DataFrame:
        return materialize(P.stratified_split(self.raw, "id", "y"))

    @cached_property
    def enc(self) -> DataFrame:
        return materialize(P.encoder_table(self.split, list(self.CATEGORICAL)))

    @cached_property
    def encoded(self) -> DataFrame:
        return P.label_encode(self.split, list(self.CATEGORICAL), self.enc)

    @cached_property
    def stats(self) -> DataFrame:
        return literal_row(P.scaler_stats(self.split.where(F.col("split") == "train"), list(_NUMS)))

    @cached_property
    def ranges(self) -> DataFrame:
        rng = P.feature_ranges(self.split, list(_NUMS))
        return literal_row(rng.agg(*[F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"{c}__{k}")
                                     for c in _NUMS for k in ("min", "max")]))

    @cached_property
    def prepared(self) -> DataFrame:
        return P.standardize(self.encoded, list(_NUMS), self.stats).select("id", "y", "split", *_NUMS, *self.CATEGORICAL)

    @property
    def train(self) -> DataFrame:
        return self.prepared.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.prepared.where(F.col("split") == "test")


def prep_bundle(spark: SparkSession, sf_dir: str) -> PrepBundle:
    return PrepBundle(spark, sf_dir)


_NUMS = ("o_totalprice", "c_acctbal", "o_custkey")
PREPARED_CTE = FEATURES_CTE + f""",
fsig AS (
  SELECT id, o_totalprice, c_acctbal, o_custkey, c_mktsegment, o_orderstatus,
         CAST(1.0 / (1.0 + exp(-((o_totalprice - 250000.0) / 100000.0)))
              > {sql_hash_uniform("CAST(id AS VARCHAR)")} AS INTEGER) AS y
  FROM features),
fenc AS (
  SELECT feature, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY label) - 1 AS INTEGER) AS code, label
  FROM (SELECT DISTINCT 'c_mktsegment' AS feature, coalesce(c_mktsegment, 'nan') AS label FROM fsig
        UNION SELECT DISTINCT 'o_orderstatus', coalesce(o_orderstatus, 'nan') FROM fsig)),
fspl AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id)
                      <= ceil(count(*) OVER (PARTITION BY y) * CAST(0.2 AS DOUBLE))
                 THEN 'test' ELSE 'train' END AS split
  FROM fsig),
fst AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUMS)}
        FROM fspl WHERE split = 'train'),
prepared AS (
  SELECT s.id, s.y, s.split,
         {", ".join(f"(s.{c} - m_{c}) / CASE WHEN coalesce(s_{c}, 0) = 0 THEN 1.0 ELSE s_{c} END AS {c}" for c in _NUMS)},
         a.code AS c_mktsegment, b.code AS o_orderstatus
  FROM fspl s CROSS JOIN fst
  LEFT JOIN fenc a ON a.feature = 'c_mktsegment' AND a.label = coalesce(s.c_mktsegment, 'nan')
  LEFT JOIN fenc b ON b.feature = 'o_orderstatus' AND b.label = coalesce(s.o_orderstatus, 'nan'))"""


def prep_parts(spark: SparkSession, sf_dir: str, bundle: PrepBundle | None = None):
    """(encoded + split frame, one-row scaler stats on train, encoder table, raw ranges)."""
    b = bundle or prep_bundle(spark, sf_dir)
    return b.encoded, b.stats, b.enc, b.ranges


def scenarios(spark: SparkSession, sf_dir: str, bundle: PrepBundle | None = None) -> DataFrame:
    """Partial what-if inputs from the test rows: ``[scenario_id, feature, value]``.

    Price is given in raw units (null on every third key -> default); the
    segment is given as is, lower-cased on every seventh key (unseen ->
    code 0) or blank on every eleventh (ignored -> default).
    """
    b = bundle or prep_bundle(spark, sf_dir)
    f = b.split.where("split = 'test'")
    k = F.col("id")
    price = F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_totalprice").cast("string"))
    seg = (F.when(k % 7 == 0, F.lower("c_mktsegment")).when(k % 11 == 0, F.lit(""))
           .otherwise(F.col("c_mktsegment")))
    rows = F.array(F.struct(F.lit("o_totalprice").alias("feature"), price.alias("value")),
                   F.struct(F.lit("c_mktsegment").alias("feature"), seg.alias("value")))
    return f.select(F.col("id").alias("scenario_id"), F.inline(rows))


SCENARIO_CTE = PREPARED_CTE + """,
raw_rng AS (SELECT """ + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _NUMS) + """ FROM fsig),
scen AS (
  SELECT id AS scenario_id, 'o_totalprice' AS feature,
         CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS value
  FROM fsig WHERE id IN (SELECT id FROM prepared WHERE split = 'test')
  UNION ALL
  SELECT id, 'c_mktsegment', CASE WHEN id % 7 = 0 THEN lower(c_mktsegment) WHEN id % 11 = 0 THEN ''
                                  ELSE c_mktsegment END
  FROM fsig WHERE id IN (SELECT id FROM prepared WHERE split = 'test')),
defaults AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS d_{c}" for c in
                                    _NUMS + ("c_mktsegment", "o_orderstatus")) + """
             FROM prepared WHERE split = 'train'),
sw AS (SELECT scenario_id, """ + ", ".join(
    f"max(CASE WHEN feature = '{c}' AND value IS NOT NULL AND trim(value) <> '' THEN value END) AS in_{c}"
    for c in _NUMS + ("c_mktsegment", "o_orderstatus")) + """ FROM scen GROUP BY scenario_id),
wrows AS (
  SELECT sw.scenario_id, """ + ", ".join(
    f"coalesce((TRY_CAST(trim(in_{c}) AS DOUBLE) - m_{c}) / CASE WHEN coalesce(s_{c}, 0) = 0 THEN 1.0 ELSE s_{c} END, d_{c}) AS {c}"
    for c in _NUMS) + """,
         CASE WHEN in_c_mktsegment IS NULL THEN d_c_mktsegment ELSE coalesce(CAST(a.code AS DOUBLE), 0.0) END AS c_mktsegment,
         CASE WHEN in_o_orderstatus IS NULL THEN d_o_orderstatus ELSE coalesce(CAST(b.code AS DOUBLE), 0.0) END AS o_orderstatus
  FROM sw CROSS JOIN defaults CROSS JOIN fst
  LEFT JOIN fenc a ON a.feature = 'c_mktsegment' AND a.label = trim(sw.in_c_mktsegment)
  LEFT JOIN fenc b ON b.feature = 'o_orderstatus' AND b.label = trim(sw.in_o_orderstatus))"""
