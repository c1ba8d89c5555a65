"""Model (M*), model persistence (S8-S10), registry (R1, R2) and formatting queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from arbiter.functions.formatting import human_readable
from arbiter.operators import evaluate as E
from arbiter.operators import models as M
from arbiter.operators import pipeline as P
from arbiter.operators import registry as R
from arbiter.operators.common import attach
from arbiter.operators.encoders import label_table
from arbiter.plans.frames import PREPARED_CTE, features_signal, p_a, prep_bundle
from arbiter.plans.q_eval import _CLS_SQL
from arbiter.plans.registry import query
from arbiter.plans.scorers import CATEGORICAL, FEATURES, LINEAR_A, LINEAR_B, NUMERIC
from arbiter.plans.util import with_ctes
from arbiter.session import scratch_path
from arbiter.sources import files
from arbiter.sources.tables import load

SCORERS = (LINEAR_A, LINEAR_B)


def _raw_split(spark, sf, bundle=None):
    """Raw (unscaled, unencoded) features with the md5 split (materialized once)."""
    b = bundle or prep_bundle(spark, sf)
    return b.split.where("split = 'train'"), b.split.where("split = 'test'")


# ---------------------------------------------------------------- MLlib models (rows checks)

@query("model_logreg")
def model_logreg(spark, sf):
    """M1: logistic regression (C=1, lbfgs) fitted on train, test-row probabilities."""
    tr, te = _raw_split(spark, sf)
    m = M.fit(tr, "logistic_regression", "classification", "y", NUMERIC, CATEGORICAL)
    return M.score(m, te)


@query("model_rf")
def model_rf(spark, sf):
    """M3: random forest classifier (100 trees, depth 10, seed 42), test-row probabilities."""
    tr, te = _raw_split(spark, sf)
    m = M.fit(tr, "random_forest", "classification", "y", NUMERIC, CATEGORICAL)
    return M.score(m, te)


_REG_NUM = ["c_acctbal", "o_custkey"]


@query("model_rf_reg")
def model_rf_reg(spark, sf):
    """M4: random forest regressor of the order price, test-row predictions."""
    tr, te = _raw_split(spark, sf)
    m = M.fit(tr, "random_forest", "regression", "o_totalprice", _REG_NUM, CATEGORICAL)
    return M.score(m, te, label="o_totalprice", task="regression")


@query("model_ols", """
SELECT round(regr_slope(o_totalprice, c_acctbal), 6) AS slope,
       round(regr_intercept(o_totalprice, c_acctbal), 2) AS intercept,
       CAST(count(*) AS BIGINT) AS n
FROM orders JOIN customer ON o_custkey = c_custkey""")
def model_ols(spark, sf):
    """M2: one-feature linear regression (normal equations) - slope and intercept."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    d = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_totalprice").alias("label"), "c_acctbal")
    d = VectorAssembler(inputCols=["c_acctbal"], outputCol="features").transform(d)
    m = LinearRegression(regParam=0.0, solver="normal").fit(d)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    one = n.select(F.round(F.lit(float(m.coefficients[0])), 6).alias("slope"),
                   F.round(F.lit(float(m.intercept)), 2).alias("intercept"), "n")
    return one


def _train_scores(spark, sf, names=("logistic_regression", "random_forest"), tr=None):
    if tr is None:
        tr, _ = _raw_split(spark, sf)
    models, status = M.train_all(tr, names, "classification", "y", NUMERIC, CATEGORICAL)
    parts = []
    for nm, m in models.items():
        s = M.score(m, tr)
        parts.append(s.agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("train_score"))
                     .select(F.lit(nm).alias("model"), "train_score"))
    return models, status, parts


@query("model_train_scores")
def model_train_scores(spark, sf):
    """M5: training accuracy (classifiers) and R² (regressor) per model."""
    tr, _ = _raw_split(spark, sf)
    _, status, parts = _train_scores(spark, sf, tr=tr)
    if failed := [f"{nm}: {error}" for nm, state, error in status if state != "success"]:
        raise RuntimeError(f"a score of every model was asked for, not trained: {'; '.join(failed)}")
    reg = M.fit(tr, "logistic_regression", "regression", "o_totalprice", _REG_NUM, CATEGORICAL)
    r2 = E.regression_metrics(M.score(reg, tr, label="o_totalprice", task="regression")
                              .withColumnRenamed("o_totalprice", "y"), by=[])
    out = spark.createDataFrame([], "model string, train_score double, task string")
    for p in parts:
        out = out.unionByName(p.withColumn("task", F.lit("classification")))
    return out.unionByName(r2.select(F.lit("linear_regression").alias("model"), F.col("r2").alias("train_score"),
                                     F.lit("regression").alias("task")))


@query("model_train_all")
def model_train_all(spark, sf):
    """M6: train every model, one status row each (failures captured, not raised)."""
    _, status, parts = _train_scores(spark, sf, ("logistic_regression", "random_forest", "gradient_boosting"))
    st = spark.createDataFrame(status, "model string, status string, error string")
    sc = spark.createDataFrame([], "model string, train_score double")
    for p in parts:
        sc = sc.unionByName(p)
    return st.join(sc, "model", "left")


@query("pipeline_full")
def pipeline_full(spark, sf):
    """Validate -> clean -> prepare -> train -> evaluate, test metrics per model."""
    out = P.run_pipeline(features_signal(spark, sf), "y")
    return out.select("model", "status", "accuracy", "precision", "recall", "f1", "roc_auc")


# rows with a missing value go; the split takes ceil(0.2 n) rows of each class (or of all)
_RUN_SQL = """
clean AS (SELECT * FROM src WHERE a IS NOT NULL AND c IS NOT NULL),
n AS (SELECT {strata} AS cls, count(*) AS n FROM clean GROUP BY 1)
SELECT m.model, m.status, '{task}' AS task_type, CAST(sum(n - ceil(n * CAST(0.2 AS DOUBLE))) AS BIGINT) AS n_train,
       CAST(sum(ceil(n * CAST(0.2 AS DOUBLE))) AS BIGINT) AS n_test, 'a,c' AS feature_names, true AS scored
FROM n, (VALUES ('logistic_regression', 'success')) m(model, status) GROUP BY m.model, m.status
UNION ALL SELECT 'gradient_boosting', 'failed', '{task}', NULL, NULL, NULL, false"""
_RUN_SRC = """
src AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS a,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS c, {target} AS target FROM orders)"""


def _run(spark, sf, target, metric, name="target"):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    src = o.select(k.alias("id"), F.when(k % 7 != 0, F.col("o_totalprice").cast("double")).alias("a"),
                   F.when(k % 11 != 0, F.col("o_orderstatus")).alias("c"), target.alias(name))
    out = P.run_pipeline(src, name, ("logistic_regression", "gradient_boosting"))
    return out.select("model", "status", "task_type", "n_train", "n_test", "feature_names", F.col(metric).isNotNull().alias("scored"))


@query("pipeline_binary", with_ctes(_RUN_SRC.format(target="CAST(o_custkey % 2 AS INTEGER)") + ",", _RUN_SQL.format(strata="target", task="classification").lstrip()))
def pipeline_binary(spark, sf):
    """M11 with a 0/1 target that is called y, missing values, and a model that can't be trained."""
    return _run(spark, sf, (F.col("o_custkey") % 2).cast("int"), "roc_auc", "y")


@query("pipeline_multiclass", with_ctes(_RUN_SRC.format(target="o_orderpriority") + ",", _RUN_SQL.format(strata="target", task="classification").lstrip()))
def pipeline_multiclass(spark, sf):
    """M11 with a string target of five classes, missing values, and a model that can't be trained."""
    return _run(spark, sf, F.col("o_orderpriority"), "roc_auc")


@query("pipeline_regression", with_ctes(_RUN_SRC.format(target="CAST(o_custkey AS DOUBLE)") + ",", _RUN_SQL.format(strata="1", task="regression").lstrip()))
def pipeline_regression(spark, sf):
    """M11 with a numeric target of many values."""
    return _run(spark, sf, F.col("o_custkey").cast("double"), "r2")


@query("model_train_r2", """
WITH f AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS a, CAST(o_custkey AS DOUBLE) * 3 + CAST(o_totalprice AS DOUBLE) AS y FROM orders)
SELECT 'linear_regression' AS model, CAST(count(a) AS BIGINT) AS n, round(corr(a, y) * corr(a, y), 6) AS train_score FROM f WHERE a IS NOT NULL""")
def model_train_r2(spark, sf):
    """M2/M5: the training R2 of a one-feature linear regression is the squared correlation."""
    k = F.col("o_orderkey")
    f = load(spark, sf, "orders").select(k.alias("id"), F.when(k % 5 != 0, F.col("o_totalprice").cast("double")).alias("a"),
                                         (F.col("o_custkey").cast("double") * 3 + F.col("o_totalprice").cast("double")).alias("y")).where("a is not null")
    s = M.score(M.fit(f, "logistic_regression", "regression", "y", ["a"], []), f, task="regression")
    r2 = E.regression_metrics(s, by=[]).select(F.lit("linear_regression").alias("model"), F.round("r2", 6).alias("train_score"))
    return attach(r2, s.agg(F.count(F.lit(1)).alias("n")))


@query("model_train_accuracy", """
SELECT 'logistic_regression' AS model, CAST(count(*) AS BIGINT) AS n, 1.0::DOUBLE AS train_score FROM orders""")
def model_train_accuracy(spark, sf):
    """M5: two groups of orders far apart are separated without an error by the trained classifier."""
    far = F.when(F.col("o_orderkey") % 2 == 0, F.lit(1e6)).otherwise(F.lit(0.0))
    f = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") + far).alias("a"),
                                         (F.col("o_orderkey") % 2 == 0).cast("int").alias("y"))
    s = M.score(M.fit(f, "logistic_regression", "classification", "y", ["a"], []), f)
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("y")).cast("double")).alias("train_score")).select(
        F.lit("logistic_regression").alias("model"), "n", "train_score")


@query("model_status", with_ctes(PREPARED_CTE, """
SELECT m.model, m.status, m.error, CAST(count(*) AS BIGINT) AS n_train
FROM prepared, (VALUES ('logistic_regression', 'success', NULL), ('gradient_boosting', 'failed', 'ValueError: Unknown model: gradient_boosting')) m(model, status, error)
WHERE split = 'train' GROUP BY m.model, m.status, m.error"""))
def model_status(spark, sf):
    """M6: one status row a model, failures with their text."""
    tr, _ = _raw_split(spark, sf)
    _, status = M.train_all(tr, ["logistic_regression", "gradient_boosting"], "classification", "y", NUMERIC, CATEGORICAL)
    return attach(spark.createDataFrame(status, "model string, status string, error string"), tr.agg(F.count(F.lit(1)).alias("n_train")))


@query("model_forest_votes", with_ctes(PREPARED_CTE, """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_not_one, CAST(0 AS BIGINT) AS n_other_class, true AS better_than_majority
FROM prepared WHERE split = 'test'"""))
def model_forest_votes(spark, sf):
    """M3: a forest's class probabilities lie in 0..1 and sum to 1, its class is the more probable one, and it beats the majority class."""
    tr, te = _raw_split(spark, sf)
    s = M.score(M.fit(tr, "random_forest", "classification", "y", NUMERIC, CATEGORICAL), te, with_prob=True)
    p0, p1 = F.get("prob", F.lit(0)), F.get("prob", F.lit(1))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~p0.between(0, 1) | ~p1.between(0, 1), 1)).alias("n_outside"),
                 F.count(F.when(F.abs(p0 + p1 - 1) > 1e-9, 1)).alias("n_not_one"),
                 F.count(F.when((p1 > p0) != (F.col("pred") == 1), 1)).alias("n_other_class"),
                 (F.avg((F.col("pred") == F.col("y")).cast("double")) > F.greatest(F.avg("y"), 1 - F.avg("y"))).alias("better_than_majority"))


@query("model_many_labels", """
WITH f AS (SELECT o_custkey, count(*) AS n, avg(CAST(o_totalprice AS DOUBLE)) AS m FROM orders GROUP BY o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS label, CAST(row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS BIGINT) AS code,
       CAST(row_number() OVER (ORDER BY m, CAST(o_custkey AS VARCHAR)) - 1 AS BIGINT) AS code_by_mean FROM f""")
def model_many_labels(spark, sf):
    """M1/M3: the joined encoder's codes of a column of many labels, alphabetical and by the labels' mean."""
    f = load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("label"), F.col("o_totalprice").cast("double").alias("price"))
    plain = label_table(f, ["label"]).select("label", "code")
    by_mean = label_table(f, ["label"], "price").select("label", F.col("code").alias("code_by_mean"))
    return plain.join(by_mean, "label")


@query("registry_history", """
WITH v AS (SELECT * FROM (VALUES (1, 0.5), (2, 0.6), (3, 0.7)) v(version, threshold)),
reg AS (SELECT 'price_rule' AS model, version, max(o_orderdate) - to_days(10 - version) AS trained_at, count(*) AS n_rows,
               count(*) FILTER (WHERE 1.0 / (1.0 + exp(-((CAST(o_totalprice AS DOUBLE) - 250000.0) / 100000.0))) >= threshold) AS n_positive
        FROM orders, v GROUP BY version)
SELECT model, CAST(version AS INTEGER) AS version, trained_at, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_positive AS BIGINT) AS n_positive, version = 3 AS is_latest FROM reg""")
def registry_history(spark, sf):
    """Three registrations of a model appended to the registry table, its history and latest row read back."""
    o = load(spark, sf, "orders")
    path = scratch_path(spark, "registry")
    for version, threshold in ((1, 0.5), (2, 0.6), (3, 0.7)):
        facts = o.agg((F.max("o_orderdate") - F.expr(f"interval {10 - version} days")).alias("trained_at"), F.count(F.lit(1)).alias("n_rows"),
                      F.count(F.when(p_a(F.col("o_totalprice")) >= threshold, 1)).alias("n_positive"))
        R.register(facts.select(F.lit("price_rule").alias("model"), F.lit(version).alias("version"), "trained_at", "n_rows", "n_positive"), path)
    last = R.latest(spark, path).select("model", F.col("version").alias("_last"))
    return R.history(spark, path, "price_rule").join(F.broadcast(last), "model").withColumn("is_latest", F.col("version") == F.col("_last")).drop("_last")  # one row a model


@query("model_logreg_mean", with_ctes(PREPARED_CTE, """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(y), 3) AS mean_y, round(avg(y), 3) AS mean_p FROM prepared WHERE split = 'train'"""))
def model_logreg_mean(spark, sf):
    """M1: with a free intercept, a logistic fit's mean probability on its training rows is the mean label."""
    tr, _ = _raw_split(spark, sf)
    s = M.score(M.fit(tr, "logistic_regression", "classification", "y", NUMERIC, CATEGORICAL), tr)
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 3).alias("mean_y"), F.round(F.avg("p"), 3).alias("mean_p"))


@query("model_forest_range", with_ctes(PREPARED_CTE, """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_outside FROM prepared WHERE split = 'test'"""))
def model_forest_range(spark, sf):
    """M4: a regression forest predicts one value for every test row, within the range of its training labels."""
    tr, te = _raw_split(spark, sf)
    s = M.score(M.fit(tr, "random_forest", "regression", "o_totalprice", _REG_NUM, CATEGORICAL), te, label="o_totalprice", task="regression")
    lo, hi = tr.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return s.agg(F.count("pred").alias("n"), F.count(F.when(~F.col("pred").between(lo, hi), 1)).alias("n_outside"))


@query("model_roundtrip_same", with_ctes(PREPARED_CTE, """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_differing FROM prepared WHERE split = 'test'"""))
def model_roundtrip_same(spark, sf):
    """A saved and loaded model gives every test row the score of the model in memory."""
    tr, te = _raw_split(spark, sf)
    m = M.fit(tr, "logistic_regression", "classification", "y", NUMERIC, CATEGORICAL)
    path = scratch_path(spark, "model-logreg")
    m.write().overwrite().save(path)
    back = M.score(PipelineModel.load(path), te).select("id", F.col("p").alias("q"))
    return M.score(m, te).join(back, "id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p") != F.col("q"), 1)).alias("n_differing"))


@query("model_roundtrip")
def model_roundtrip(spark, sf):
    """Pipeline (indexers + scaler + model) saved to the shared folder, loaded, scored."""
    tr, te = _raw_split(spark, sf)
    m = M.fit(tr, "logistic_regression", "classification", "y", NUMERIC, CATEGORICAL)
    path = scratch_path(spark, "model-logreg")
    m.write().overwrite().save(path)
    back = PipelineModel.load(path)
    return M.score(back, te)


# ---------------------------------------------------------------- linear scorers (SQL checks)

def _test(spark, sf, bundle=None):
    return (bundle or prep_bundle(spark, sf)).test


_DEC = PREPARED_CTE + ",\ndecided AS (" + "\nUNION ALL\n".join(
    f"SELECT id, '{s.name}' AS model, y, {s.sql_p()} AS p, {s.sql_pred()} AS pred FROM prepared WHERE split = 'test'"
    for s in SCORERS) + ")"


def _decided(spark, sf, bundle=None):
    t = _test(spark, sf, bundle)
    parts = [t.select("id", F.lit(s.name).alias("model"), "y", s.p().alias("p"), s.pred().alias("pred"))
             for s in SCORERS]
    return parts[0].unionByName(parts[1])


@query("score_linear", with_ctes(PREPARED_CTE, f"""
SELECT id, {LINEAR_A.sql_z()} AS z, {LINEAR_A.sql_p()} AS p, {LINEAR_A.sql_pred()} AS pred
FROM prepared WHERE split = 'test'"""), doubles=("z", "p"))
def score_linear(spark, sf):
    """M7: linear scorer predictions on the test rows."""
    return LINEAR_A.score(_test(spark, sf)).select("id", "z", "p", "pred")


@query("score_proba", with_ctes(PREPARED_CTE, f"""
SELECT id, 1 - {LINEAR_A.sql_p()} AS prob_0, {LINEAR_A.sql_p()} AS prob_1 FROM prepared WHERE split = 'test'"""),
       doubles=("prob_0", "prob_1"))
def score_proba(spark, sf):
    """M8: class probabilities."""
    p = LINEAR_A.p()
    return _test(spark, sf).select("id", (1 - p).alias("prob_0"), p.alias("prob_1"))


@query("score_with_confidence", with_ctes(PREPARED_CTE, f"""
SELECT id, {LINEAR_A.sql_pred()} AS prediction, greatest({LINEAR_A.sql_p()}, 1 - {LINEAR_A.sql_p()}) AS confidence
FROM prepared WHERE split = 'test'"""), doubles=("confidence",))
def score_with_confidence(spark, sf):
    """M9: prediction with max-probability confidence."""
    p = LINEAR_A.p()
    prob = F.array(1 - p, p)
    return _test(spark, sf).select("id", LINEAR_A.pred().alias("prediction"), F.array_max(prob).alias("confidence"))


@query("score_sample_check", with_ctes(_DEC, """
SELECT model, id, y, pred, CAST(pred = y AS INTEGER) AS correct FROM decided"""))
def score_sample_check(spark, sf):
    """Every test row scored by every model with a correctness flag."""
    d = _decided(spark, sf)
    return d.select("model", "id", "y", "pred", (F.col("pred") == F.col("y")).cast("int").alias("correct"))


_TYPES = {"linear_a": "LinearScorer", "linear_b": "LinearScorer"}
_META_SQL = _DEC + "," + _CLS_SQL


@query("registry_metadata", with_ctes(_META_SQL, f"""
SELECT model, 'LinearScorer' AS model_type, 'classification' AS task,
       (SELECT max(o_orderdate) FROM orders) AS trained_at, accuracy, precision, recall, f1, roc_auc,
       '{",".join(FEATURES)}' AS feature_names, {len(FEATURES)} AS feature_count
FROM allm"""), doubles=("accuracy", "precision", "recall", "f1", "roc_auc"))
def registry_metadata(spark, sf):
    """Registry rows with metrics computed on the test rows."""
    metrics = E.evaluate_models(_decided(spark, sf))
    trained = load(spark, sf, "orders").agg(F.max("o_orderdate").alias("trained_at"))
    return R.metadata(metrics, _TYPES, "classification", trained, FEATURES)


# fixed values: the written card sections per model (linear_b leaves two out)
CARD_TEXTS = {
    "linear_a": {"intended_use": "Rank orders for expedited handling",
                 "limitations": "Fixed coefficients; not retrained on new data",
                 "ethical_considerations": "Uses order and account attributes only",
                 "recommendations": "Review the decision threshold every quarter"},
    "linear_b": {"intended_use": "Second opinion for order handling",
                 "limitations": "Fixed coefficients; weaker on large orders"},
}


def _cards(spark, sf):
    b = prep_bundle(spark, sf)
    metrics = E.evaluate_models(_decided(spark, sf, b))
    trained = load(spark, sf, "orders").agg(F.max("o_orderdate").alias("trained_at"))
    meta = R.metadata(metrics, _TYPES, "classification", trained, FEATURES)
    p = b.prepared
    facts = p.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
                  F.count(F.when(F.col("split") == "test", 1)).alias("n_test"))
    return R.card(meta, facts, CARD_TEXTS)


def _sql_text(model_col, section):
    cases = " ".join(f"WHEN '{m}' THEN '{t[section]}'" for m, t in CARD_TEXTS.items() if section in t)
    return f"CASE {model_col} {cases} END" if cases else "CAST(NULL AS VARCHAR)"


_CARD_SQL = _META_SQL + """,
facts AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS n_train,
                 count(*) FILTER (WHERE split = 'test') AS n_test FROM prepared),
cards AS (
  SELECT model, 'LinearScorer' AS model_type, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_train AS BIGINT) AS n_train,
         CAST(n_test AS BIGINT) AS n_test, """ + str(len(FEATURES)) + """ AS feature_count,
         model || ' LinearScorer' AS model_details,
         """ + _sql_text("model", "intended_use") + """ AS intended_use,
         printf('%d rows, %d train / %d test (%.0f%% test), %d features', n_rows, n_train, n_test,
                n_test / n_rows * 100, """ + str(len(FEATURES)) + """) AS training_data,
         printf('accuracy %.4f, f1 %.4f, roc_auc %.4f', accuracy, f1, roc_auc) AS performance,
         """ + _sql_text("model", "limitations") + """ AS limitations,
         """ + _sql_text("model", "ethical_considerations") + """ AS ethical_considerations,
         """ + _sql_text("model", "recommendations") + """ AS recommendations
  FROM allm CROSS JOIN facts)"""


@query("registry_card", with_ctes(_CARD_SQL, "SELECT * FROM cards"))
def registry_card(spark, sf):
    """Model card per model (facts computed), exported as JSON and read back."""
    c = _cards(spark, sf).drop("sections")
    return files.roundtrip_json(spark, c, c.schema, "cards-json")


@query("registry_completeness", with_ctes(_CARD_SQL, """
SELECT model, CAST(7 - len(missing) AS INTEGER) AS sections_present, array_to_string(missing, ',') AS sections_missing,
       (7 - len(missing)) / 7 * 100 AS completeness_pct
FROM (SELECT model, list_sort(list_filter(['model_details', 'intended_use', 'training_data', 'performance',
        'limitations', 'ethical_considerations', 'recommendations'],
        lambda s: (s = 'intended_use' AND intended_use IS NULL) OR (s = 'limitations' AND limitations IS NULL)
          OR (s = 'ethical_considerations' AND ethical_considerations IS NULL)
          OR (s = 'recommendations' AND recommendations IS NULL))) AS missing FROM cards)"""),
       doubles=("completeness_pct",))
def registry_completeness(spark, sf):
    """R2: card sections present and missing, % complete."""
    return R.completeness(_cards(spark, sf))


@query("fmt_human_readable", """
WITH m AS (
  SELECT 'o_totalprice' AS feature, avg(o_totalprice) AS value FROM orders
  UNION ALL SELECT 'c_acctbal', avg(c_acctbal) FROM customer
  UNION ALL SELECT 'l_quantity', avg(l_quantity) FROM lineitem
  UNION ALL SELECT 'discount_rate', avg(l_discount) * 100 FROM lineitem
  UNION ALL SELECT 'num_customers', CAST(count(*) AS DOUBLE) FROM customer
  UNION ALL SELECT 'order_age_days', avg(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')) FROM orders
  UNION ALL SELECT 'tenure_months', avg(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')) / 30 FROM orders)
SELECT feature, value,
  CASE WHEN regexp_matches(lower(feature), 'charge|cost|price|payment|bill|amount|salary|income|fee')
         THEN '$' || format('{:,.2f}', value)
       WHEN regexp_matches(lower(feature), 'percent|rate|pct|ratio') THEN format('{:.1f}', value) || '%'
       WHEN regexp_matches(lower(feature), 'count|quantity|num|total_charges|times|calls|contracts|months')
         THEN CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR)
       WHEN regexp_matches(lower(feature), 'age|tenure|year|month|day|length')
         THEN CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) ||
              CASE WHEN contains(lower(feature), 'tenure') OR contains(lower(feature), 'month') THEN ' months'
                   ELSE ' years' END
       ELSE format('{:.2f}', value) END AS display
FROM m""", doubles=("value",))
def fmt_human_readable(spark, sf):
    """2.16: human-readable display of aggregate values by feature name."""
    o, c, li = load(spark, sf, "orders"), load(spark, sf, "customer"), load(spark, sf, "lineitem")
    age = F.datediff(F.lit("2002-01-01").cast("timestamp_ntz"), F.col("o_orderdate"))
    parts = [o.agg(F.avg("o_totalprice").alias("value")).select(F.lit("o_totalprice").alias("feature"), "value"),
             c.agg(F.avg("c_acctbal").alias("value")).select(F.lit("c_acctbal").alias("feature"), "value"),
             li.agg(F.avg("l_quantity").alias("value")).select(F.lit("l_quantity").alias("feature"), "value"),
             li.agg((F.avg("l_discount") * 100).alias("value")).select(F.lit("discount_rate").alias("feature"), "value"),
             c.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("num_customers").alias("feature"), "value"),
             o.agg(F.avg(age).alias("value")).select(F.lit("order_age_days").alias("feature"), "value"),
             o.agg((F.avg(age) / 30).alias("value")).select(F.lit("tenure_months").alias("feature"), "value")]
    m = parts[0]
    for p in parts[1:]:
        m = m.unionByName(p)
    return m.select("feature", "value", human_readable(F.col("feature"), F.col("value")).alias("display"))
