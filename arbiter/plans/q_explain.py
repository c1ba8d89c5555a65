"""Explanation queries (X*) over the prepared frame with the linear scorer."""

from __future__ import annotations

from arbiter.functions.hashing import sql_hash_uniform
from arbiter.operators import explain as X
from arbiter.plans.frames import PREPARED_CTE, prep_bundle
from arbiter.plans.registry import query
from arbiter.plans.scorers import FEATURES, LINEAR_A
from arbiter.plans.util import with_ctes

S = LINEAR_A


def _split(spark, sf):
    b = prep_bundle(spark, sf)
    return b.train, b.test


_PERM_SQL = PREPARED_CTE + """,
test AS (SELECT * FROM prepared WHERE split = 'test'),
feats AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}')" for f in FEATURES) + """) f(feature)),
recv AS (SELECT t.*, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS pos FROM test t),
donor AS (
  SELECT r.rep, """ + ", ".join(f"CAST(t.{f} AS DOUBLE) AS d_{f}" for f in FEATURES) + """,
         row_number() OVER (PARTITION BY r.rep
                            ORDER BY md5(CAST(t.id AS VARCHAR) || ':' || CAST(r.rep AS VARCHAR) || ':42'), t.id) AS pos
  FROM test t CROSS JOIN range(0, 10) r(rep)),
sub AS (
  SELECT x.y, f.feature, d.rep, """ + ", ".join(
    f"CASE WHEN f.feature = '{f}' THEN d.d_{f} ELSE CAST(x.{f} AS DOUBLE) END AS {f}" for f in FEATURES) + """
  FROM recv x JOIN donor d ON d.pos = x.pos CROSS JOIN feats f),
acc AS (SELECT feature, rep, avg(CAST(""" + S.sql_pred() + """ = y AS DOUBLE)) AS acc FROM sub GROUP BY feature, rep),
base AS (SELECT avg(CAST(""" + S.sql_pred() + """ = y AS DOUBLE)) AS baseline FROM test),
imp AS (SELECT feature, avg(baseline - acc) AS importance, stddev_pop(baseline - acc) AS importance_std
        FROM acc, base GROUP BY feature)"""


@query("explain_permutation", with_ctes(_PERM_SQL, """
SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp"""),
       doubles=("importance", "importance_std"))
def explain_permutation(spark, sf):
    """Permutation importance (accuracy, 10 repeats) on the test rows."""
    _, te = _split(spark, sf)
    return X.permutation_importance(te, S)


_SHAP_SQL = PREPARED_CTE + """,
bgm AS (SELECT """ + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in FEATURES) + """
        FROM prepared WHERE split = 'train'),
shap AS (
  SELECT t.id, """ + f"({S.intercept!r}" + "".join(f" + ({c!r}) * m_{f}" for f, c in S.coef.items()) + """) AS base_value,
         """ + S.sql_z("t") + """ AS z, u.feature, u.ordinal, u.value, u.phi
  FROM prepared t CROSS JOIN bgm,
  LATERAL (SELECT * FROM (VALUES """ + ", ".join(
    f"('{f}', {i}, CAST(t.{f} AS DOUBLE), ({S.coef[f]!r}) * (CAST(t.{f} AS DOUBLE) - m_{f}))"
    for i, f in enumerate(FEATURES)) + """) v(feature, ordinal, value, phi)) u
  WHERE t.split = 'test')"""


@query("explain_linear_shap", with_ctes(_SHAP_SQL, "SELECT * FROM shap"),
       doubles=("base_value", "z", "value", "phi"))
def explain_linear_shap(spark, sf):
    """Exact linear SHAP (log-odds) for every test row."""
    tr, te = _split(spark, sf)
    return X.linear_shap(te, S, tr)


@query("explain_local", with_ctes(_SHAP_SQL, """
SELECT id, feature, phi, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank,
       'linear_shap' AS method FROM shap"""), doubles=("phi",))
def explain_local(spark, sf):
    """Per-row contributions ordered by |phi|."""
    tr, te = _split(spark, sf)
    phi = X.linear_shap(te, S, tr).select("id", "feature", "phi")
    return X.local_explanation(phi).select("id", "feature", "phi", "rank", "method")


@query("explain_global", with_ctes(_SHAP_SQL, """
SELECT feature, avg(abs(phi)) AS mean_abs_phi, avg(phi) AS mean_phi FROM shap GROUP BY feature"""),
       doubles=("mean_abs_phi", "mean_phi"))
def explain_global(spark, sf):
    """Global mean |phi| per feature over the test rows."""
    tr, te = _split(spark, sf)
    return X.global_importance(X.linear_shap(te, S, tr))


K_SAMPLES = 8
_NF = len(FEATURES)


def _hyb(f):
    return f"CASE WHEN pos_{f} < step THEN {f} ELSE b_{f} END"


# hybrid row: instance value once the feature is switched on, background value before
_HYB_Z = f"({S.intercept!r}" + "".join(f" + ({c!r}) * ({_hyb(f)})" for f, c in S.coef.items()) + ")"

_MC_SQL = PREPARED_CTE + """,
bg AS (SELECT id AS bk, """ + ", ".join(f"CAST({f} AS DOUBLE) AS b_{f}" for f in FEATURES) + """,
              row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS bpos
       FROM prepared WHERE split = 'train'),
nbg AS (SELECT count(*) AS n FROM bg),
inst AS (
  SELECT t.id, """ + ", ".join(f"CAST(t.{f} AS DOUBLE) AS {f}" for f in FEATURES) + """, k.k,
         CAST(floor(""" + sql_hash_uniform("CAST(t.id AS VARCHAR) || ':' || CAST(k.k AS VARCHAR) || ':42'") + """ * nbg.n) + 1 AS BIGINT) AS bpos
  FROM prepared t, range(0, """ + str(K_SAMPLES) + """) k(k), nbg WHERE t.split = 'test'),
hj AS (
  SELECT i.*, """ + ", ".join(f"b.b_{f}" for f in FEATURES) + ", " + ", ".join(
    f"md5(CAST(i.id AS VARCHAR) || ':' || CAST(i.k AS VARCHAR) || ':{f}:42') AS h_{f}" for f in FEATURES) + """
  FROM inst i JOIN bg b USING (bpos)),
pos AS (SELECT *, """ + ", ".join(
    "(" + " + ".join(f"CASE WHEN h_{g} < h_{f} THEN 1 ELSE 0 END" for g in FEATURES if g != f) + f") AS pos_{f}"
    for f in FEATURES) + """ FROM hj),
steps AS (SELECT pos.*, s.step FROM pos, range(0, """ + str(_NF + 1) + """) s(step)),
sc AS (SELECT id, k, step,
              CASE """ + " ".join(f"WHEN pos_{f} = step - 1 THEN '{f}'" for f in FEATURES) + """ END AS feature,
              (1.0 / (1.0 + exp(-""" + _HYB_Z + """))) AS fp FROM steps),
d AS (SELECT id, k, step, feature, fp - lag(fp) OVER (PARTITION BY id, k ORDER BY step) AS phi FROM sc)"""


@query("explain_sampled_shapley", with_ctes(_MC_SQL, """
SELECT id, feature, avg(phi) AS phi FROM d WHERE step > 0 GROUP BY id, feature"""), doubles=("phi",))
def explain_sampled_shapley(spark, sf):
    """Monte-Carlo Shapley values (probability units), 8 samples per test row."""
    tr, te = _split(spark, sf)
    return X.sampled_shapley(te, S, tr, samples=K_SAMPLES).drop("phi_se")
