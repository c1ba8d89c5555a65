"""Feature attribution: permutation importance, exact linear SHAP, sampled Shapley.

The reference loops (per feature x repeat, per row) in Python; here each
loop is a column of an exploded frame, scored once.  Permutations and
background draws come from md5 ranks (two-level scan), so they are
reproducible and never pass through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.functions.hashing import hash_hex, hash_uniform
from arbiter.operators import shapley
from arbiter.operators.common import attach
from arbiter.operators.ordered import hash_rank
from arbiter.operators.scorer import LinearScorer

N_REPEATS = 10


def _value_of(feature_col: str, features: Sequence[str]):
    """``CASE feature WHEN 'a' THEN a ...`` - the value of the named feature."""
    e = None
    for f in features:
        c = F.col(f).cast("double")
        e = F.when(F.col(feature_col) == f, c) if e is None else e.when(F.col(feature_col) == f, c)
    return e


def _score_agg(pred: str, label: str, scoring: str):
    """Aggregate of a scored frame: accuracy, or R2 (population moments of the label)."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    if scoring == "accuracy":
        return F.avg((y == p).cast("double"))
    if scoring == "r2":
        return 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))
    raise ValueError(f"unknown scoring {scoring!r}")


def permutation_importance(df: DataFrame, scorer, label: str = "y", key: str = "id",
                           repeats: int = N_REPEATS, seed: int = 42, scoring: str = "accuracy") -> DataFrame:
    """Drop of accuracy (or R2: ``scoring="r2"``) when one feature is permuted, mean over repeats.

    Repeat r uses one permutation of the rows: the row at position i in
    md5(key:seed) order receives the values of the row at position i in
    md5(key:r:seed) order.  Each feature is permuted on its own (the other
    features keep their values), so one ranked donor table of rows x repeats
    serves every feature.
    """
    base = scorer.apply(df, pred="_pred").agg(_score_agg("_pred", label, scoring).alias("baseline"))
    acc = (_permuted(df, scorer, label, key, repeats, seed).groupBy("feature", "rep")
           .agg(_score_agg("_pred", label, scoring).alias("acc")))
    imp = attach(acc, base).groupBy("feature").agg(
        F.avg(F.col("baseline") - F.col("acc")).alias("importance"),
        F.stddev_pop(F.col("baseline") - F.col("acc")).alias("importance_std"))
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # one row per feature
    return imp.withColumn("rank", F.row_number().over(w))


def _permuted(df: DataFrame, scorer, label: str, key: str, repeats: int, seed: int) -> DataFrame:
    """Every row once a (feature, repeat), scored with that feature's permuted value."""
    feats = list(scorer.features)
    recv = hash_rank(df.withColumn("_h", hash_hex(F.col(key), seed)), [], "_h", key, "_pos")
    donors = df.select(key, *[F.col(f).cast("double").alias(f"_d_{f}") for f in feats],
                       F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    donors = donors.withColumn("_h", hash_hex(F.col(key), F.col("rep"), seed))
    donors = hash_rank(donors, ["rep"], "_h", key, "_pos").select("rep", "_pos", *[f"_d_{f}" for f in feats])
    j = recv.select(label, "_pos", *feats).join(donors, "_pos", "inner")
    j = j.select("*", F.explode(F.array(*[F.lit(f) for f in feats])).alias("feature"))
    cols = {f: F.when(F.col("feature") == f, F.col(f"_d_{f}")).otherwise(F.col(f).cast("double")) for f in feats}
    return scorer.apply(j, cols, p="_p", pred="_pred")


def permutation_importance_by_class(df: DataFrame, scorer, label: str = "y", key: str = "id",
                                    repeats: int = N_REPEATS, seed: int = 42) -> DataFrame:
    """``permutation_importance`` for every class of ``scorer`` against the rest (X1): ``class`` is a column.

    A class's score is the accuracy of "is of the class"; the permuted rows are scored once for all classes.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(scorer.n_classes - 1))).alias("class")

    def accuracy(scored: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        c = scored.groupBy(*by, F.col(label).alias("_y"), "_pred").count().select("*", every)  # one row a confusion cell
        hit = (F.col("_y") == F.col("class")) == (F.col("_pred") == F.col("class"))
        return c.groupBy(*by, "class").agg((F.sum(hit.cast("long") * F.col("count")) / F.sum(F.when(hit.isNotNull(), F.col("count")))).alias(name))

    base = accuracy(scorer.apply(df, pred="_pred"), [], "baseline")
    acc = accuracy(_permuted(df, scorer, label, key, repeats, seed), ["feature", "rep"], "acc")
    imp = acc.join(F.broadcast(base), "class").groupBy("class", "feature").agg(
        F.avg(F.col("baseline") - F.col("acc")).alias("importance"), F.stddev_pop(F.col("baseline") - F.col("acc")).alias("importance_std"))
    w = Window.partitionBy("class").orderBy(F.col("importance").desc(), F.col("feature"))  # one row per feature
    return imp.withColumn("rank", F.row_number().over(w))


def linear_shap(df: DataFrame, scorer: LinearScorer, background: DataFrame, key: str = "id") -> DataFrame:
    """Exact SHAP of a linear model in log-odds: ``coef_i (x_i - mean_i)``.

    ``base_value = intercept + sum coef_i mean_i`` over the background
    (the training rows); ``sum phi + base_value = z`` for every row.
    """
    feats = list(scorer.features)
    means = background.agg(*[F.avg(F.col(f).cast("double")).alias(f"{f}__m") for f in feats])
    base = F.lit(float(scorer.intercept))
    for f in feats:
        base = base + F.lit(float(scorer.coef[f])) * F.col(f"{f}__m")
    j = attach(df, means)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("ordinal"),
                              F.col(f).cast("double").alias("value"),
                              (F.lit(float(scorer.coef[f])) * (F.col(f).cast("double") - F.col(f"{f}__m")))
                              .alias("phi")) for i, f in enumerate(feats)])
    return j.select(key, base.alias("base_value"), scorer.z().alias("z"), F.inline(rows))


def sampled_shapley(df: DataFrame, scorer, background: DataFrame, key: str = "id",
                    samples: int = 8, seed: int = 42) -> DataFrame:
    """Monte-Carlo Shapley values in probability units (X3), with their standard error ``phi_se``
    over the samples (the error falls with the square root of ``samples``; null for one sample).

    For each (row, sample k): a feature order from md5(key:k:feature) and a
    background row picked by md5 rank; the F+1 hybrid rows switch features
    from background to instance one at a time; consecutive prediction
    differences are the contributions, so over a row's features they sum to the
    difference between the row's and its background rows' mean prediction.
    Any scorer works: a columnar one is evaluated inside the row, a fitted
    model over the exploded hybrids.
    """
    feats = list(scorer.features)
    nf = len(feats)
    bg = background.select(F.col(key).alias("_bk"), *[F.col(f).cast("double").alias(f"_b_{f}") for f in feats])
    bg = hash_rank(bg.withColumn("_h", hash_hex(F.col("_bk"), seed)), [], "_h", "_bk", "_bpos")
    nbg = background.agg(F.count(F.lit(1)).alias("_nbg"))
    ks = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k")
    inst = attach(df.select(key, *[F.col(f).cast("double").alias(f) for f in feats], ks), nbg)
    inst = inst.withColumn("_bpos", (F.floor(hash_uniform(F.col(key), F.col("k"), seed) * F.col("_nbg")) + 1)
                           .cast("long"))
    j = inst.join(bg.drop("_h", "_bk"), "_bpos", "inner")
    # position of every feature in this sample's order: rank of its hash among the features
    hs = {f: hash_hex(F.col(key), F.col("k"), f, seed) for f in feats}
    pos = {f: sum((F.when(hs[g] < hs[f], 1).otherwise(0) for g in feats if g != f), F.lit(0)) for f in feats}
    j = j.select(key, "k", *feats, *[f"_b_{f}" for f in feats], *[pos[f].alias(f"_pos_{f}") for f in feats])
    result = (F.avg("phi").alias("phi"), (F.stddev_samp("phi") / F.sqrt(F.lit(float(samples)))).alias("phi_se"))
    if scorer.columnar:
        at = [scorer.p({f: F.when(F.col(f"_pos_{f}") < s, F.col(f)).otherwise(F.col(f"_b_{f}")) for f in feats})
              for s in range(nf + 1)]
        row = j.select(key, "k", F.array(*at).alias("_f"), *[F.col(f"_pos_{f}") for f in feats])
        phi = F.array(*[F.struct(F.lit(f).alias("feature"), (F.get("_f", F.col(f"_pos_{f}") + 1)
                                                            - F.get("_f", F.col(f"_pos_{f}"))).alias("phi")) for f in feats])
        return row.select(key, F.inline(phi)).groupBy(key, "feature").agg(*result)
    steps = j.select("*", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("step"))
    cols = {f: F.when(F.col(f"_pos_{f}") < F.col("step"), F.col(f)).otherwise(F.col(f"_b_{f}")) for f in feats}
    # the feature switched on between step-1 and step is the one at position step-1
    switched = None
    for f in feats:
        c = F.when(F.col(f"_pos_{f}") == F.col("step") - 1, F.lit(f))
        switched = c if switched is None else F.coalesce(switched, c)
    sc = (scorer.apply(steps, cols, p="_fp", pred="_pred")
          .select(key, "k", "step", switched.alias("feature"), "_fp"))
    w = Window.partitionBy(key, "k").orderBy("step")  # F+1 rows per partition
    diffs = sc.withColumn("phi", F.col("_fp") - F.lag("_fp").over(w)).where(F.col("step") > 0)
    return diffs.groupBy(key, "feature").agg(*result)


def explain(df: DataFrame, scorer, background: DataFrame, key: str = "id", samples: int | None = None, top: int | None = None) -> DataFrame:
    """Full local explanations (X4, X6): ``[id, method, base_value, prediction, feature, value, phi, rank]``.

    A linear scorer gets its exact contributions (log odds), a fitted tree or forest the exact values along its paths,
    another scorer of up to ``shapley.MAX_FEATURES`` features the exact values against a bounded background,
    the rest sampled Shapley values (as does any scorer but a linear one when ``samples`` is given); a scorer without
    features gets the fallback's zeros for the numeric columns of ``df``.  With more than two classes every class
    is explained, and ``class`` is a column.
    """
    feats = list(scorer.features)
    if not feats:
        cols = [c for c, t in df.dtypes if c != key and t in ("int", "bigint", "double", "float")]
        out = fallback_explanation(df, cols, key).withColumn("base_value", F.lit(0.0)).withColumn("prediction", F.lit(None).cast("double"))
        return local_explanation(out.withColumn("value", F.lit(None).cast("double")), key, top, "fallback_no_shap")
    if isinstance(scorer, LinearScorer):
        phi = linear_shap(df, scorer, background, key).withColumnRenamed("z", "prediction").drop("ordinal")
        return local_explanation(phi, key, top)
    many = scorer.n_classes > 2
    by = [key, "class"] if many else [key]
    if samples is None and shapley.is_forest(scorer):
        phi = shapley.model_shapley(df, scorer.model, feats, key)
        return local_explanation(phi if many else phi.drop("class"), by, top, "tree_shapley")
    values = df.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats])))
    if samples is None and len(feats) <= shapley.MAX_FEATURES:
        phi = shapley.exact_shapley(df, scorer, background, key, classes=scorer.n_classes if many else 0)
        return local_explanation(phi.join(values, [key, "feature"]), by, top, "exact_shapley")

    def sampled(one) -> DataFrame:
        rows = one.apply(df, p="_p", pred="_pred").select(key, F.col("_p").alias("prediction"))
        phi = sampled_shapley(df, one, background, key, samples or 8).join(values, [key, "feature"]).join(rows, key)
        return attach(phi, one.apply(background, p="_p", pred="_pred").agg(F.avg("_p").alias("base_value")))
    if not many:
        return local_explanation(sampled(scorer), by, top, "sampled_shapley")
    parts = [sampled(scorer.for_class(k)).withColumn("class", F.lit(k)) for k in range(scorer.n_classes)]
    phi = parts[0]
    for p in parts[1:]:
        phi = phi.unionByName(p)
    return local_explanation(phi, by, top, "sampled_shapley")


def local_explanation(phi: DataFrame, key: str | Sequence[str] = "id", top: int | None = None,
                      method: str = "linear_shap") -> DataFrame:
    """Contributions per row (and class) ordered by |phi| (X4, with X6's method tag)."""
    by = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*by).orderBy(F.abs(F.col("phi")).desc(), F.col("feature"))
    out = phi.withColumn("rank", F.row_number().over(w)).withColumn("method", F.lit(method))
    return out.where(F.col("rank") <= top) if top else out


def fallback_explanation(df: DataFrame, features: Sequence[str], key: str = "id") -> DataFrame:
    """Zero contributions when no explainer applies."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(0.0).alias("phi")) for f in features])
    return df.select(key, F.inline(rows), F.lit("fallback_no_shap").alias("method"))


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean |phi| and mean phi per feature."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi"))
