"""What-if (W*) and counterfactual (K*) queries with the linear scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import counterfactual as K
from arbiter.operators import whatif as W
from arbiter.operators.scorer import LinearScorer, OneHotScorer, onehot_groups
from arbiter.plans.frames import PREPARED_CTE, SCENARIO_CTE, prep_bundle, scenarios
from arbiter.plans.registry import query
from arbiter.plans.scorers import CATEGORICAL, FEATURES, LINEAR_A, LINEAR_B, NUMERIC
from arbiter.plans.util import with_ctes
from arbiter.sources.tables import load

S = LINEAR_A


def _rows(spark, sf):
    b = prep_bundle(spark, sf)
    defaults = b.train.agg(*[F.avg(F.col(f).cast("double")).alias(f"{f}__default") for f in FEATURES])
    rows = W.build_rows(scenarios(spark, sf, b), FEATURES, NUMERIC, CATEGORICAL, defaults, b.stats, b.enc)
    return rows, b.stats, b.ranges


def sql_z(s: LinearScorer, expr) -> str:
    return f"({s.intercept!r}" + "".join(f" + ({c!r}) * ({expr(f)})" for f, c in s.coef.items()) + ")"


def sql_p(s, expr):
    return f"(1.0 / (1.0 + exp(-{sql_z(s, expr)})))"


def sql_pred(s, expr):
    return f"CAST({sql_p(s, expr)} >= {s.threshold!r} AS INTEGER)"


@query("whatif_build", with_ctes(SCENARIO_CTE, "SELECT * FROM wrows"), doubles=tuple(FEATURES))
def whatif_build(spark, sf):
    """Model rows from partial scenarios (defaults, unseen -> 0, blanks ignored)."""
    return _rows(spark, sf)[0]


@query("whatif_predict", with_ctes(SCENARIO_CTE, f"""
SELECT scenario_id, 'linear_a' AS model, {S.sql_pred()} AS prediction,
       greatest({S.sql_p()}, 1 - {S.sql_p()}) AS confidence FROM wrows"""), doubles=("confidence",))
def whatif_predict(spark, sf):
    """Prediction and confidence per scenario."""
    return W.predict(_rows(spark, sf)[0], S)


@query("whatif_compare", with_ctes(SCENARIO_CTE, "\nUNION ALL\n".join(f"""
SELECT scenario_id, '{s.name}' AS model, {s.sql_pred()} AS prediction,
       greatest({s.sql_p()}, 1 - {s.sql_p()}) AS confidence FROM wrows""" for s in (LINEAR_A, LINEAR_B))),
       doubles=("confidence",))
def whatif_compare(spark, sf):
    """Every scorer for every scenario."""
    return W.compare(_rows(spark, sf)[0], [LINEAR_A, LINEAR_B])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("whatif_onehot", with_ctes(SCENARIO_CTE, "SELECT scenario_id, " + ", ".join(
    f"coalesce(CAST(trim(value) = '{c}' AS INTEGER), 0) AS c_mktsegment_{c}" for c in SEGMENTS)
    + " FROM scen WHERE feature = 'c_mktsegment'"))
def whatif_onehot(spark, sf):
    """One-hot segment columns per scenario (categories from the encoder table)."""
    b = prep_bundle(spark, sf)
    # the category list is a bounded parameter (one name per category)
    cats = [r["label"] for r in b.enc.where("feature = 'c_mktsegment'").orderBy("code").collect()]
    return W.onehot(scenarios(spark, sf, b), "c_mktsegment", cats)


_WIDE_PRED = sql_pred(LINEAR_B, lambda f: {"c_mktsegment": "coalesce(CAST(seg AS DOUBLE), 0.0)", "o_orderstatus": "0.0"}.get(f, f"w.{f}"))
_WIDE_P = sql_p(LINEAR_B, lambda f: {"c_mktsegment": "coalesce(CAST(seg AS DOUBLE), 0.0)", "o_orderstatus": "0.0"}.get(f, f"w.{f}"))


@query("whatif_onehot_predict", with_ctes(SCENARIO_CTE, f"""
SELECT w.scenario_id, 'linear_b' AS model, {_WIDE_PRED} AS prediction, greatest({_WIDE_P}, 1 - {_WIDE_P}) AS confidence
FROM wrows w JOIN (SELECT scenario_id, min(a.code) AS seg FROM scen LEFT JOIN fenc a ON a.feature = 'c_mktsegment' AND a.label = trim(scen.value)
                   WHERE scen.feature = 'c_mktsegment' GROUP BY scenario_id) s USING (scenario_id)"""), doubles=("confidence",))
def whatif_onehot_predict(spark, sf):
    """One-hot scenario rows scored by a model over codes; blank and unseen categories have the first code."""
    b = prep_bundle(spark, sf)
    enc = b.enc.where("feature in ('c_mktsegment', 'o_orderstatus')").orderBy("feature", "code").collect()  # a name a category
    wide = [f"{r['feature']}_{r['label']}" for r in enc]
    groups = onehot_groups([*NUMERIC, *wide], CATEGORICAL)
    sc = scenarios(spark, sf, b)
    return W.predict(W.onehot_rows(sc, _rows(spark, sf)[0], NUMERIC, groups), OneHotScorer(LINEAR_B, groups))


@query("feat_onehot_options", """
SELECT 'c_mktsegment' AS feature, c_mktsegment AS option, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS ordinal, n
FROM (SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment)""")
def feat_onehot_options(spark, sf):
    """F9 on one-hot columns: the options are the columns' suffixes; with the number of rows of each."""
    c = load(spark, sf, "customer")
    names = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a name a category
    wide = c.select(*[(F.col("c_mktsegment") == x).cast("int").alias(f"c_mktsegment_{x}") for x in names])
    options = onehot_groups(wide.columns, ["c_mktsegment"])["c_mktsegment"]
    counts = wide.agg(*[F.sum(f"`c_mktsegment_{x}`").alias(x) for x in options])
    each = F.array(*[F.struct(F.lit("c_mktsegment").alias("feature"), F.lit(x).alias("option"), F.lit(i).alias("ordinal"), F.col(f"`{x}`").alias("n")) for i, x in enumerate(options)])
    return counts.select(F.inline(each))


_N_SENS = 10


def _scaled_price(raw):
    return f"(({raw}) - m_o_totalprice) / CASE WHEN coalesce(s_o_totalprice, 0) = 0 THEN 1.0 ELSE s_o_totalprice END"


_SENS_RAW = (f"CASE WHEN g.step = {_N_SENS - 1} THEN mx_o_totalprice ELSE mn_o_totalprice + g.step * "
             f"((mx_o_totalprice - mn_o_totalprice) / {float(_N_SENS - 1)!r}) END")


@query("whatif_sensitivity", with_ctes(SCENARIO_CTE, f"""
SELECT scenario_id, CAST(step AS INTEGER) AS step, feature_value, {sql_pred(S, lambda f: 'sp' if f == 'o_totalprice' else f)} AS prediction,
       greatest({sql_p(S, lambda f: 'sp' if f == 'o_totalprice' else f)},
                1 - {sql_p(S, lambda f: 'sp' if f == 'o_totalprice' else f)}) AS confidence
FROM (SELECT w.*, g.step, {_SENS_RAW} AS feature_value, {_scaled_price(_SENS_RAW)} AS sp
      FROM wrows w CROSS JOIN raw_rng CROSS JOIN fst CROSS JOIN range(0, {_N_SENS}) g(step))"""),
       doubles=("feature_value", "confidence"))
def whatif_sensitivity(spark, sf):
    """Every scenario with the price varied over 10 values of its range."""
    rows, stats, ranges = _rows(spark, sf)
    lo, hi = F.col("o_totalprice__min"), F.col("o_totalprice__max")
    from arbiter.operators.common import attach
    return W.sensitivity(attach(rows, ranges), S, "o_totalprice", lo, hi, _N_SENS, stats)


_REC_VARS = ["o_totalprice", "c_acctbal"]
_N_REC = 5


def _rec_sql():
    parts = []
    for fi, f in enumerate(_REC_VARS):
        raw = (f"CASE WHEN g.step = {_N_REC - 1} THEN mx_{f} ELSE mn_{f} + g.step * "
               f"((mx_{f} - mn_{f}) / {float(_N_REC - 1)!r}) END")
        sc = f"(({raw}) - m_{f}) / CASE WHEN coalesce(s_{f}, 0) = 0 THEN 1.0 ELSE s_{f} END"
        parts.append(f"""
SELECT w.scenario_id, {fi} AS fi, g.step, '{f}' AS feature, {raw} AS value,
       {sql_pred(S, lambda x, f=f, sc=sc: sc if x == f else 'w.' + x)} AS prediction
FROM wrows w CROSS JOIN raw_rng CROSS JOIN fst CROSS JOIN range(0, {_N_REC}) g(step)""")
    return "cand AS (" + "\nUNION ALL\n".join(parts) + ")"


@query("whatif_recommend", with_ctes(SCENARIO_CTE + "," + _rec_sql(), """
SELECT scenario_id, rank, feature, value FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY fi, step) AS INTEGER) AS rank
  FROM cand WHERE prediction = 1)
WHERE rank <= 5"""), doubles=("value",))
def whatif_recommend(spark, sf):
    """Up to 5 scenario variants (price or balance over 5 values) predicted positive."""
    rows, stats, ranges = _rows(spark, sf)
    return W.recommend(rows, S, 1, ranges, stats, _REC_VARS, _N_REC)


# ---------------------------------------------------------------- counterfactuals

def _tt(spark, sf):
    b = prep_bundle(spark, sf)
    return b.train, b.test


def _cands_sql(qs):
    parts = [f"SELECT '{f}' AS feature, {j} AS cand_ord, quantile_cont({f}, {q!r}) AS new_value FROM train"
             for f in NUMERIC for j, q in enumerate(qs)]
    parts += [f"SELECT '{f}', CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER), v FROM "
              f"(SELECT DISTINCT CAST({f} AS DOUBLE) AS v FROM train WHERE {f} IS NOT NULL)" for f in CATEGORICAL]
    return "cands AS (" + "\nUNION ALL\n".join(parts) + ")"


def _orig(alias="t"):
    return "CASE c.feature " + " ".join(f"WHEN '{f}' THEN CAST({alias}.{f} AS DOUBLE)" for f in FEATURES) + " END"


def _expand_sql(qs):
    return PREPARED_CTE + """,
train AS (SELECT * FROM prepared WHERE split = 'train'),
test AS (SELECT * FROM prepared WHERE split = 'test'),
""" + _cands_sql(qs) + """,
vr AS (SELECT feature, row_number() OVER (ORDER BY round(variance, 9) DESC NULLS LAST, feature) AS var_rank FROM (""" + \
        " UNION ALL ".join(f"SELECT '{f}' AS feature, var_samp(CAST({f} AS DOUBLE)) AS variance FROM train"
                           for f in FEATURES) + """)),
e AS (
  SELECT t.id, c.feature, c.cand_ord, """ + _orig() + """ AS original_value, c.new_value,
         abs(c.new_value - """ + _orig() + """) AS change,
         """ + sql_pred(S, lambda f: f"CAST(t.{f} AS DOUBLE)") + """ AS original_prediction,
         """ + sql_pred(S, lambda f: f"CASE WHEN c.feature = '{f}' THEN c.new_value ELSE CAST(t.{f} AS DOUBLE) END") + """
           AS new_prediction
  FROM test t CROSS JOIN cands c)"""


_CAT_LIST = ", ".join(f"'{c}'" for c in CATEGORICAL)
_FIND_SQL = _expand_sql(K.QUANTILES) + f""",
fl AS (SELECT e.*, vr.var_rank FROM e JOIN vr USING (feature)
       WHERE new_prediction <> original_prediction
         AND NOT (feature IN ({_CAT_LIST}) AND new_value = original_value)),
top AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY change, var_rank, cand_ord) AS INTEGER) AS rank,
               feature, original_value, new_value, change, original_prediction, new_prediction FROM fl)"""


@query("cf_find", with_ctes(_FIND_SQL, "SELECT * FROM top WHERE rank <= 3"),
       doubles=("original_value", "new_value", "change"))
def cf_find(spark, sf):
    """K1: the three smallest single-feature changes that flip each test prediction."""
    tr, te = _tt(spark, sf)
    return K.find(te, tr, S, NUMERIC, CATEGORICAL).drop("num_found")


@query("cf_explain", with_ctes(_FIND_SQL, f"""
SELECT t.id, CASE WHEN f.feature IS NULL THEN 'No simple single-feature change found to flip prediction.'
  ELSE printf('To change prediction from %d to %d: Change %s from %.2f to %.2f',
              {S.sql_pred('t')}, 1 - {S.sql_pred('t')}, f.feature, f.original_value, f.new_value) END AS explanation
FROM test t LEFT JOIN (SELECT * FROM top WHERE rank = 1) f USING (id)"""))
def cf_explain(spark, sf):
    """K3: one-sentence flip explanation per test row."""
    tr, te = _tt(spark, sf)
    return K.explain_flip(K.find_packed(te, tr, S, NUMERIC, CATEGORICAL, top=1)).drop("top_explanation")


@query("cf_multiple", with_ctes(_expand_sql(K.DIVERSE_QUANTILES) + f""",
e2 AS (SELECT *, row_number() OVER (PARTITION BY id, feature ORDER BY cand_ord) AS vr
       FROM e WHERE NOT (feature IN ({_CAT_LIST}) AND new_value = original_value)),
fl AS (SELECT *, list_position([{", ".join(f"'{f}'" for f in FEATURES)}], feature) AS fo
       FROM e2 WHERE vr <= 3 AND new_prediction <> original_prediction)""", """
SELECT id, rank, 'single_feature' AS type, feature, original_value, new_value, new_prediction FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY fo, cand_ord) AS INTEGER) AS rank FROM fl)
WHERE rank <= 5"""), doubles=("original_value", "new_value"))
def cf_multiple(spark, sf):
    """K2: up to five diverse single-feature flips per test row."""
    tr, te = _tt(spark, sf)
    return K.find_multiple(te, tr, S, NUMERIC, CATEGORICAL)


def _sens_sql():
    ext = ", ".join(f"min(CAST({f} AS DOUBLE)) AS mn_{f}, max(CAST({f} AS DOUBLE)) AS mx_{f}" for f in NUMERIC)
    ext += ", " + ", ".join(f"count(DISTINCT {f}) AS nd_{f}" for f in CATEGORICAL)
    parts = []
    for f in NUMERIC:
        lo = sql_pred(S, lambda x, f=f: f"mn_{f}" if x == f else f"CAST(t.{x} AS DOUBLE)")
        hi = sql_pred(S, lambda x, f=f: f"mx_{f}" if x == f else f"CAST(t.{x} AS DOUBLE)")
        op = sql_pred(S, lambda x: f"CAST(t.{x} AS DOUBLE)")
        parts.append(f"""SELECT t.id, '{f}' AS feature, CAST(t.{f} AS DOUBLE) AS current_value,
  CASE WHEN {lo} <> {op} THEN abs(mn_{f} - t.{f}) WHEN {hi} <> {op} THEN abs(mx_{f} - t.{f}) END AS required_change
FROM test t CROSS JOIN ext""")
    for f in CATEGORICAL:
        parts.append(f"""SELECT t.id, '{f}', CAST(t.{f} AS DOUBLE), CASE WHEN nd_{f} > 1 THEN 1.0 END
FROM test t CROSS JOIN ext""")
    return PREPARED_CTE + """,
train AS (SELECT * FROM prepared WHERE split = 'train'),
test AS (SELECT * FROM prepared WHERE split = 'test'),
ext AS (SELECT """ + ext + """ FROM train),
s AS (""" + "\nUNION ALL\n".join(parts) + ")"


@query("cf_sensitivity", with_ctes(_sens_sql(), """
SELECT id, feature, current_value, required_change,
       round(CASE WHEN current_value <> 0 THEN required_change / abs(current_value) * 100 ELSE 0.0 END, 2)
         AS change_percentage,
       CAST(row_number() OVER (PARTITION BY id ORDER BY required_change, feature) AS INTEGER) AS rank
FROM s WHERE required_change IS NOT NULL"""), doubles=("current_value", "required_change", "change_percentage"))
def cf_sensitivity(spark, sf):
    """K4: change needed to flip per feature (min then max of training range)."""
    tr, te = _tt(spark, sf)
    out = K.sensitivity_to_flip(te, tr, S, NUMERIC, CATEGORICAL)
    # the percentage divides by values near zero: compare it at 2 dp
    return out.withColumn("change_percentage", F.round("change_percentage", 2))


@query("cf_rank_variance", with_ctes(PREPARED_CTE, """
SELECT feature, variance,
       CAST(row_number() OVER (ORDER BY round(variance, 9) DESC NULLS LAST, feature) AS INTEGER) AS var_rank FROM (""" +
    " UNION ALL ".join(f"SELECT '{f}' AS feature, var_samp(CAST({f} AS DOUBLE)) AS variance FROM prepared "
                       f"WHERE split = 'train'" for f in FEATURES) + ")"), doubles=("variance",))
def cf_rank_variance(spark, sf):
    """K5: features ranked by training variance."""
    tr, _ = _tt(spark, sf)
    return K.variance_rank(tr, FEATURES)


@query("cf_inverse_scale", with_ctes(SCENARIO_CTE, "\nUNION ALL\n".join(f"""
SELECT t.id, '{f}' AS feature, CAST(t.{f} AS DOUBLE) AS scaled_value,
       least(greatest(mn_{f} + (t.{f} + 3) * ((mx_{f} - mn_{f}) / 6), mn_{f}), mx_{f}) AS approx_value,
       t.{f} * s_{f} + m_{f} AS exact_value
FROM prepared t CROSS JOIN raw_rng CROSS JOIN fst WHERE t.split = 'test'""" for f in NUMERIC)),
       doubles=("scaled_value", "approx_value", "exact_value"))
def cf_inverse_scale(spark, sf):
    """K6: scaled test values back to original units (approximate and exact)."""
    b = prep_bundle(spark, sf)
    return K.inverse_scale(b.test.select("id", *NUMERIC), NUMERIC, b.ranges, b.stats)
