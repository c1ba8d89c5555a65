"""Exact Shapley values (X3) and the class axis of explanations, scenarios and counterfactuals."""

from __future__ import annotations

import itertools
import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from arbiter.operators import counterfactual as K
from arbiter.operators import explain as X
from arbiter.operators import models as M
from arbiter.operators import shapley as H
from arbiter.operators import whatif as W
from arbiter.operators.common import attach
from arbiter.operators.scorer import ModelScorer
from arbiter.plans.frames import PREPARED_CTE, features_signal, prep_bundle
from arbiter.plans.q_whatif import _cands_sql, _orig
from arbiter.plans.registry import query
from arbiter.plans.scorers import CATEGORICAL, FEATURES, LINEAR_A, NUMERIC, SOFTMAX
from arbiter.plans.util import with_ctes

_N = len(FEATURES)


def _split(spark, sf):
    b = prep_bundle(spark, sf)
    return b.train, b.test


# the label of the three-class queries
_Y3 = "CASE WHEN id % 4 = 0 THEN 2 ELSE y END"


def _y3(df):
    return df.withColumn("y", F.when(F.col("id") % 4 == 0, 2).otherwise(F.col("y")))


# ---------------------------------------------------------------- exact values against a background

def _exact_sql(p: str, extra: str = "") -> str:
    """Mean prediction of every set of features, summed with the weights |S|! (n - |S| - 1)! / n!."""
    w = [math.factorial(s) * math.factorial(_N - s - 1) / math.factorial(_N) for s in range(_N)]
    at = lambda i: "CASE " + " ".join(f"WHEN {i} = {s} THEN {x!r}::DOUBLE" for s, x in enumerate(w)) + " END"
    phi = ", ".join(f"sum(p * CASE WHEN mask & {1 << i} > 0 THEN {at('bit_count(mask) - 1')} ELSE -({at('bit_count(mask)')}) END) / count(*) FILTER (WHERE mask = 0) AS phi_{f}"
                    for i, f in enumerate(FEATURES))
    by = f"id{extra}"
    return PREPARED_CTE + f""",
bg AS (SELECT * FROM prepared WHERE split = 'train' ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT {H.BACKGROUND}),
hyb AS (SELECT t.id, m.mask, """ + ", ".join(
        f"CASE WHEN m.mask & {1 << i} > 0 THEN CAST(t.{f} AS DOUBLE) ELSE CAST(bg.{f} AS DOUBLE) END AS {f}" for i, f in enumerate(FEATURES)) + f"""
        FROM prepared t CROSS JOIN bg CROSS JOIN range(0, {1 << _N}) m(mask) WHERE t.split = 'test'),
scored AS ({p}),
sums AS (SELECT {by}, {phi}, avg(p) FILTER (WHERE mask = 0) AS base_value, avg(p) FILTER (WHERE mask = {(1 << _N) - 1}) AS prediction
         FROM scored GROUP BY {by})
SELECT {by}, u.feature, u.phi, base_value, prediction FROM sums,
LATERAL (SELECT * FROM (VALUES {", ".join(f"('{f}', phi_{f})" for f in FEATURES)}) v(feature, phi)) u"""


@query("explain_exact_shapley", "WITH " + _exact_sql(f"SELECT id, mask, {LINEAR_A.sql_p()} AS p FROM hyb").strip(), doubles=("phi", "base_value", "prediction"))
def explain_exact_shapley(spark, sf):
    """Exact Shapley values of the probability against 50 training rows, all 32 sets of features."""
    tr, te = _split(spark, sf)
    return H.exact_shapley(te, LINEAR_A, tr)


@query("explain_exact_classes", "WITH " + _exact_sql("\nUNION ALL ".join(
    f"SELECT id, mask, {k} AS class, {SOFTMAX.sql_p(k)} AS p FROM hyb" for k in range(3)), ", class").strip(), doubles=("phi", "base_value", "prediction"))
def explain_exact_classes(spark, sf):
    """X3 with a class axis: exact Shapley values of each of three classes' probabilities."""
    tr, te = _split(spark, sf)
    return H.exact_shapley(te, SOFTMAX, tr, classes=3)


# ---------------------------------------------------------------- trees

def _node(tree, node, left=-1, right=-1, feature=None, threshold=None, categories=None, n_categories=None, p=0.0):
    i = FEATURES.index(feature) if feature else None
    return (tree, node, left, right, i, threshold, categories, n_categories, 0.0, [1.0 - p, p])


#: two trees of two levels: a split on a category, and a feature that a path meets twice
TREES = [
    _node(0, 0, 1, 2, "o_totalprice", 0.0), _node(0, 1, 3, 4, "c_acctbal", 0.25), _node(0, 2, 5, 6, "c_mktsegment", None, [0.0, 3.0], 5),
    _node(0, 3, p=0.1), _node(0, 4, p=0.35), _node(0, 5, p=0.6), _node(0, 6, p=0.9),
    _node(1, 0, 1, 2, "o_custkey", 0.1), _node(1, 1, 3, 4, "o_custkey", -0.5), _node(1, 2, 5, 6, "o_totalprice", 0.7),
    _node(1, 3, p=0.2), _node(1, 4, p=0.5), _node(1, 5, p=0.4), _node(1, 6, p=0.8)]


def _tree_sql() -> str:
    """Every leaf's value of every set of its path's features, by enumeration."""
    nodes = {(n[0], n[1]): n for n in TREES}
    counts, phi, base = [], {f: [] for f in FEATURES}, []

    def walk(tree, i, met, path):
        n = nodes[tree, i]
        counts.append(f"count(*) FILTER (WHERE {' AND '.join(met) or 'true'})::DOUBLE AS n_{tree}_{i}")
        if n[2] < 0:
            value = f"{n[9][1] / 2!r}"
            term = {f: ("CAST(" + " AND ".join(c) + " AS INTEGER)", " * ".join(z)) for f, (c, z) in path.items()}
            base.append(f"{value} * " + " * ".join(z for _, z in term.values()))
            for f in term:
                rest = [g for g in term if g != f]
                parts = []
                for size in range(len(rest) + 1):
                    for inside in itertools.combinations(rest, size):
                        w = math.factorial(size) * math.factorial(len(rest) - size) / math.factorial(len(rest) + 1)
                        parts.append(" * ".join([repr(w), *[term[g][0] if g in inside else term[g][1] for g in rest]]))
                phi[f].append(f"{value} * ({term[f][0]} - {term[f][1]}) * ({' + '.join(parts)})")
            return
        f = FEATURES[n[4]]
        left = f"{f} IN ({', '.join(map(repr, n[6]))})" if n[6] else f"{f} <= {n[5]!r}"
        for child, cond in ((n[2], left), (n[3], f"NOT ({left})")):
            c, z = path.get(f, ([], []))
            walk(tree, child, [*met, cond], path | {f: ([*c, cond], [*z, f"(n_{tree}_{child} / n_{tree}_{i})"])})

    for tree in (0, 1):
        walk(tree, 0, [], {})
    each = ", ".join(f"('{f}', CAST({f} AS DOUBLE), {' + '.join(phi[f]) or '0.0'})" for f in FEATURES)
    return PREPARED_CTE + f""",
cov AS (SELECT {", ".join(counts)} FROM prepared WHERE split = 'train'),
ph AS (SELECT t.id, u.feature, u.value, CAST(u.phi AS DOUBLE) AS phi, {" + ".join(base)} AS base_value
       FROM prepared t CROSS JOIN cov, LATERAL (SELECT * FROM (VALUES {each}) v(feature, value, phi)) u WHERE t.split = 'test')
SELECT id, 1 AS class, feature, value, phi, base_value, base_value + sum(phi) OVER (PARTITION BY id) AS prediction FROM ph"""


@query("explain_tree_shapley", "WITH " + _tree_sql().strip(), doubles=("value", "phi", "base_value", "prediction"))
def explain_tree_shapley(spark, sf):
    """Exact path-dependent Shapley values of two fixed trees, with the training rows as their covers."""
    tr, te = _split(spark, sf)
    nodes = H.with_covers(spark.createDataFrame(TREES, H.NODES), tr, FEATURES)
    return H.tree_shapley(te, nodes, FEATURES)


def _fitted(spark, sf):
    b = prep_bundle(spark, sf)
    tr, te = b.split.where("split = 'train'"), b.split.where("split = 'test'")
    return ModelScorer("forest", M.fit(tr, "random_forest", "classification", "y", NUMERIC, CATEGORICAL), NUMERIC + CATEGORICAL), tr, te


_N_TEST = ", CAST(0 AS BIGINT) AS ".join(["SELECT CAST(count(*) AS BIGINT) AS n", "n_not_additive", "n_other_base", "n_other_prediction"]) \
    + " FROM prepared WHERE split = 'test'"


@query("explain_forest_additive", with_ctes(PREPARED_CTE, _N_TEST))
def explain_forest_additive(spark, sf):
    """X3/X4 on a fitted forest: every test row's contributions and the base sum to the model's own probability."""
    scorer, tr, te = _fitted(spark, sf)
    phi = X.explain(te, scorer, tr)
    rows = phi.groupBy("id").agg(F.sum("phi").alias("s"), F.first("base_value").alias("base"), F.first("prediction").alias("p"), F.countDistinct("base_value").alias("nb"))
    own = M.score(scorer.model, te).select("id", F.col("p").alias("q"))
    far = lambda e: F.count(F.when(F.abs(e) > 1e-9, 1))
    return rows.join(own, "id").agg(F.count(F.lit(1)).alias("n"), far(F.col("base") + F.col("s") - F.col("q")).alias("n_not_additive"),
                                    F.count(F.when(F.col("nb") > 1, 1)).alias("n_other_base"), far(F.col("p") - F.col("q")).alias("n_other_prediction"))


def _small_forest(tr):
    """A fitted forest over the model-space features."""
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"), RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=5, seed=M.SEED)]
    return ModelScorer("forest", Pipeline(stages=stages).fit(tr), FEATURES)


@query("cf_forest_flips", with_ctes(PREPARED_CTE, """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_unconfirmed, CAST(0 AS BIGINT) AS n_other_original, true AS some_flips
FROM prepared WHERE split = 'test'"""))
def cf_forest_flips(spark, sf):
    """K1 on a fitted forest: the model gives every changed row the reported class, and every instance its original one."""
    tr, te = _split(spark, sf)
    forest = _small_forest(tr)
    found = K.find(te, tr, forest, NUMERIC, CATEGORICAL)
    cols = {f: F.when(F.col("feature") == f, F.col("new_value")).otherwise(F.col(f)) for f in FEATURES}
    changed = forest.apply(te.join(found, "id"), cols, p="_p", pred="again")
    wrong = changed.groupBy("id").agg(F.count(F.when(F.col("again") != F.col("new_prediction"), 1)).alias("off"), F.first("original_prediction").alias("was"))
    own = forest.apply(te, p="_p", pred="own").select("id", "own")
    return own.join(wrong, "id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("off") > 0, 1)).alias("n_unconfirmed"),
        F.count(F.when(F.col("was") != F.col("own"), 1)).alias("n_other_original"), (F.count("off") > 0).alias("some_flips"))


@query("whatif_forest", with_ctes(PREPARED_CTE, """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) * 5 AS BIGINT) AS n_steps, CAST(0 AS BIGINT) AS n_other_class, CAST(0 AS BIGINT) AS n_low_confidence
FROM prepared WHERE split = 'test'"""))
def whatif_forest(spark, sf):
    """W3/W5 on a fitted forest: predictions are the model's own, confidences those of the predicted class, and the
    five steps of a sensitivity curve are answered for every scenario."""
    tr, te = _split(spark, sf)
    forest = _small_forest(tr)
    rows = te.withColumnRenamed("id", "scenario_id")
    one = W.predict(rows, forest).join(forest.apply_classes(rows, prob="_prob").select("scenario_id", "_prob"), "scenario_id")
    got = one.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("prediction") != (F.get("_prob", F.lit(1)) >= 0.5).cast("int"), 1)).alias("n_other_class"),
                  F.count(F.when((F.abs(F.col("confidence") - F.array_max("_prob")) > 1e-12) | (F.col("confidence") < 0.5), 1)).alias("n_low_confidence"))
    return attach(got, W.sensitivity(rows, forest, "o_totalprice", -1, 1, 5).agg(F.count("prediction").alias("n_steps")))


# ---------------------------------------------------------------- classes

@query("whatif_classes", with_ctes(PREPARED_CTE, "SELECT scenario_id, model, class, probability, "
       "CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY probability DESC, class) AS INTEGER) AS rank FROM (" + "\nUNION ALL ".join(
    f"SELECT id AS scenario_id, 'softmax' AS model, {k} AS class, {SOFTMAX.sql_p(k)} AS probability FROM prepared WHERE split = 'test'" for k in range(3)) + ")"),
    doubles=("probability",))
def whatif_classes(spark, sf):
    """W3 with a class axis: every class's probability for every test row, ranked."""
    _, te = _split(spark, sf)
    return W.predict_classes(te.withColumnRenamed("id", "scenario_id"), SOFTMAX)


@query("whatif_predict_classes", with_ctes(PREPARED_CTE, f"""
SELECT id AS scenario_id, 'softmax' AS model, {SOFTMAX.sql_pred()} AS prediction, greatest({", ".join(SOFTMAX.sql_p(k) for k in range(3))}) AS confidence
FROM prepared WHERE split = 'test'"""), doubles=("confidence",))
def whatif_predict_classes(spark, sf):
    """Class and confidence of a three-class scorer."""
    _, te = _split(spark, sf)
    return W.predict(te.withColumnRenamed("id", "scenario_id"), SOFTMAX)


def _pred3(value) -> str:
    z = [f"({SOFTMAX.intercept[k]!r}" + "".join(f" + ({c!r}) * ({value(f)})" for f, c in SOFTMAX.coef[k].items()) + ")" for k in range(3)]
    return f"CAST(CASE {' '.join(f'WHEN {x} = greatest({chr(44).join(z)}) THEN {k}' for k, x in enumerate(z))} END AS INTEGER)"


_CAT_LIST = ", ".join(f"'{c}'" for c in CATEGORICAL)


@query("cf_find_class", with_ctes(PREPARED_CTE, """,
train AS (SELECT * FROM prepared WHERE split = 'train'),
test AS (SELECT * FROM prepared WHERE split = 'test'),
""".lstrip() + _cands_sql(K.QUANTILES) + """,
vr AS (SELECT feature, row_number() OVER (ORDER BY round(variance, 9) DESC NULLS LAST, feature) AS var_rank FROM (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, var_samp(CAST({f} AS DOUBLE)) AS variance FROM train" for f in FEATURES) + """)),
e AS (
  SELECT t.id, c.feature, c.cand_ord, """ + _orig() + " AS original_value, c.new_value, abs(c.new_value - " + _orig() + """) AS change,
         """ + _pred3(lambda f: f"CAST(t.{f} AS DOUBLE)") + """ AS original_prediction,
         """ + _pred3(lambda f: f"CASE WHEN c.feature = '{f}' THEN c.new_value ELSE CAST(t.{f} AS DOUBLE) END") + f""" AS new_prediction
  FROM test t CROSS JOIN cands c),
fl AS (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY change, var_rank, cand_ord) AS r, count(*) OVER (PARTITION BY id) AS num_found
       FROM e JOIN vr USING (feature) WHERE new_prediction <> original_prediction AND new_prediction = 2
         AND NOT (feature IN ({_CAT_LIST}) AND new_value = original_value))
SELECT id, CAST(r AS INTEGER) AS rank, feature, original_value, new_value, change, original_prediction, new_prediction, CAST(num_found AS INTEGER) AS num_found
FROM fl WHERE r <= 3"""), doubles=("original_value", "new_value", "change"))
def cf_find_class(spark, sf):
    """K1 with a named class: the three smallest changes that turn a prediction into class 2."""
    tr, te = _split(spark, sf)
    return K.find(te, tr, SOFTMAX, NUMERIC, CATEGORICAL, target=2)


@query("explain_permutation_classes", with_ctes(PREPARED_CTE, f""",
test AS (SELECT * REPLACE ({_Y3} AS y) FROM prepared WHERE split = 'test'),
feats AS (SELECT * FROM (VALUES """.lstrip() + ", ".join(f"('{f}')" for f in FEATURES) + """) f(feature)),
recv AS (SELECT t.*, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS pos FROM test t),
donor AS (
  SELECT r.rep, """ + ", ".join(f"CAST(t.{f} AS DOUBLE) AS d_{f}" for f in FEATURES) + """,
         row_number() OVER (PARTITION BY r.rep ORDER BY md5(CAST(t.id AS VARCHAR) || ':' || CAST(r.rep AS VARCHAR) || ':42'), t.id) AS pos
  FROM test t CROSS JOIN range(0, 4) r(rep)),
sub AS (
  SELECT x.y, f.feature, d.rep, """ + ", ".join(f"CASE WHEN f.feature = '{f}' THEN d.d_{f} ELSE CAST(x.{f} AS DOUBLE) END AS {f}" for f in FEATURES) + """
  FROM recv x JOIN donor d ON d.pos = x.pos CROSS JOIN feats f),
acc AS (SELECT feature, rep, k AS class, avg(CAST((y = k) = (""" + SOFTMAX.sql_pred() + """ = k) AS DOUBLE)) AS acc FROM sub, range(0, 3) c(k) GROUP BY feature, rep, k),
base AS (SELECT k AS class, avg(CAST((y = k) = (""" + SOFTMAX.sql_pred() + """ = k) AS DOUBLE)) AS baseline FROM test, range(0, 3) c(k) GROUP BY k),
imp AS (SELECT class, feature, avg(baseline - acc) AS importance, stddev_pop(baseline - acc) AS importance_std FROM acc JOIN base USING (class) GROUP BY class, feature)
SELECT CAST(class AS INTEGER) AS class, feature, importance, importance_std,
       CAST(row_number() OVER (PARTITION BY class ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp"""), doubles=("importance", "importance_std"))
def explain_permutation_classes(spark, sf):
    """X1 with a class axis: how much each class against the rest loses when a feature is permuted, four repeats."""
    _, te = _split(spark, sf)
    return X.permutation_importance_by_class(_y3(te), SOFTMAX, repeats=4)


@query("explain_fallback", """
SELECT o_orderkey AS id, u.feature, 0.0::DOUBLE AS phi, 'fallback_no_shap' AS method, CAST(u.rank AS INTEGER) AS rank FROM orders,
LATERAL (SELECT * FROM (VALUES ('o_custkey', 1), ('o_totalprice', 2)) v(feature, rank)) u""", doubles=("phi",))
def explain_fallback(spark, sf):
    """A scorer that no explainer takes gets zeros for every numeric column of every row."""
    from arbiter.operators.scorer import LinearScorer
    o = features_signal(spark, sf).select("id", "o_totalprice", F.col("o_custkey"), "o_orderstatus")
    return X.explain(o, LinearScorer("none", {}), o).select("id", "feature", "phi", "method", "rank")
