"""Counterfactuals: which single-feature changes flip a prediction.

The candidate changes (features x quantiles / categories) are attached to every
instance as one array.  A columnar scorer tries them inside the row, so
ranking needs no shuffle; a fitted model scores the exploded changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.operators.common import attach
from arbiter.operators.sketches import quantiles as sketch_quantiles
from arbiter.operators.stats import exact_quantiles

QUANTILES = (0.25, 0.5, 0.75, 0.9)
DIVERSE_QUANTILES = (0.25, 0.5, 0.75)
MAX_CANDIDATES = 10_000             # candidates that travel in one broadcast row


def variance_rank(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """``[feature, variance, var_rank]``: sample variance, highest first (K5)."""
    wide = train.agg(*[F.var_samp(F.col(f).cast("double")).alias(f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("variance")) for f in features])
    long = wide.select(F.inline(rows))
    # standardized features share variance n/(n-1): rank on 9 dp so float noise cannot order them
    w = Window.orderBy(F.round("variance", 9).desc_nulls_last(), F.col("feature"))  # one row per feature
    return long.withColumn("var_rank", F.row_number().over(w))


def candidates(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
               quantiles: Sequence[float] = QUANTILES, sketches: DataFrame | None = None) -> DataFrame:
    """``[feature, cand_ord, new_value]``: exact quantiles of numeric features and
    every distinct value of categorical ones (both from the training rows).

    All features are melted to ``[feature, value]`` first, so the quantiles
    and the category lists each take one pass for all features.  With ``sketches`` (merged ones,
    ``sketches.merge``) the quantiles are estimates from them, and the training rows are read for categories only.
    """
    melt = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"))
                     for f in list(numeric) + list(categorical)])
    long = train.select(F.inline(melt))
    if sketches is not None:
        q = sketch_quantiles(sketches.where(F.col("feature").isin(*numeric)), quantiles)
        num = q.select("feature", F.col("idx").alias("cand_ord"), F.col("value").alias("new_value"))
    else:
        q = exact_quantiles(long.where(F.col("feature").isin(*numeric)), "v", quantiles, ["feature"], "new_value")
        num = q.select("feature", F.col("new_value_idx").alias("cand_ord"), "new_value")
    d = (long.where(F.col("feature").isin(*categorical) & F.col("v").isNotNull())
         .select("feature", F.col("v").alias("new_value")).distinct())
    w = Window.partitionBy("feature").orderBy("new_value")  # distinct categories: bounded
    cat = d.select("feature", (F.row_number().over(w) - 1).alias("cand_ord"), "new_value")
    return num.unionByName(cat)


def _tried(instances: DataFrame, cands: DataFrame, scorer, key: str, keep, order, limit: int | None) -> DataFrame:
    """``[key, original_prediction, _c]``: an array of the tried changes of every instance that ``keep``
    (a predicate on one change) lets through, sorted by the fields ``order`` and cut to ``limit``,
    and ``num_found``, the number before the cut.

    A columnar scorer tries all changes inside the row; a fitted model scores the exploded changes,
    which are put together by key again.  The candidate list travels as one broadcast row while it
    has at most ``MAX_CANDIDATES`` entries; longer lists are cut into so many chunks, each instance meets
    every chunk, and the survivors of the chunks are merged by key.
    """
    feats = list(scorer.features)
    n = cands.count()
    chunks = max(1, -(-n // MAX_CANDIDATES))
    packed = (cands.withColumn("_chunk", F.pmod(F.xxhash64("feature", "cand_ord"), F.lit(chunks)).cast("int"))
              .groupBy("_chunk").agg(F.collect_list(F.struct("feature", "cand_ord", "new_value", "var_rank")).alias("_cands")))
    base = scorer.apply(instances.select(key, *[F.col(f).cast("double").alias(f) for f in feats]),
                        p="_p0", pred="original_prediction")
    if chunks == 1:
        j = attach(base, packed.drop("_chunk"))
    else:
        j = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk")).join(packed, "_chunk")

    def original(feature):
        e = None
        for f in feats:
            e = F.when(feature == f, F.col(f)) if e is None else e.when(feature == f, F.col(f))
        return e

    def change(c):
        return F.struct(*[c[x].alias(x) for x in ("feature", "cand_ord", "original_value", "new_value", "change", "var_rank", "new_prediction")])

    class Tried(dict):
        """A candidate with its prediction; the rest of a change is an expression that only survivors compute."""

        def __init__(self, x):
            c = x["c"]
            super().__init__({k: c[k] for k in ("feature", "cand_ord", "new_value", "var_rank")} | {"new_prediction": x["pred"]})
            self["original_value"] = original(c["feature"])
            self["change"] = F.abs(self["new_value"] - self["original_value"])

    if scorer.columnar:
        tried = F.transform("_cands", lambda c: F.struct(c.alias("c"), scorer.pred(
            {f: F.when(c["feature"] == f, c["new_value"]).otherwise(F.col(f)) for f in feats}).alias("pred")))
        kept = F.filter(tried, lambda x: keep(Tried(x), F.col("original_prediction")))
        j = j.select(key, "original_prediction", F.coalesce(F.transform(kept, lambda x: change(Tried(x))), F.array()).alias("_c"))
    else:
        e = j.select("*", F.explode("_cands").alias("_t")).drop("_cands")
        cols = {f: F.when(F.col("_t.feature") == f, F.col("_t.new_value")).otherwise(F.col(f)) for f in feats}
        e = scorer.apply(e, cols, p="_p", pred="_pred")
        one = Tried({"c": F.col("_t"), "pred": F.col("_pred")})
        tried = e.where(keep(one, F.col("original_prediction"))).groupBy(key, "original_prediction").agg(F.collect_list(change(one)).alias("_c"))
        j = base.select(key, "original_prediction").join(tried, [key, "original_prediction"], "left")
        j = j.withColumn("_c", F.coalesce("_c", F.expr("array()")))

    def ranked(c):  # array_sort orders structs by their fields
        return F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.struct(*[x[o] for o in order]).alias("o"), x.alias("x")))),
                           lambda y: y["x"])

    cut = (lambda c: F.slice(c, 1, limit)) if limit else (lambda c: c)
    j = j.select(key, "original_prediction", cut(ranked(F.col("_c"))).alias("_c"), F.size("_c").alias("num_found"))
    if chunks == 1:
        return j
    g = j.groupBy(key, "original_prediction").agg(F.flatten(F.collect_list("_c")).alias("_c"), F.sum("num_found").alias("num_found"))
    return g.select(key, "original_prediction", cut(ranked(F.col("_c"))).alias("_c"), "num_found")


def _ranked_candidates(train, feats, cands, importance=None) -> DataFrame:
    """Candidates with the rank of their feature: by given importance, else by variance."""
    if importance is None:
        rank = variance_rank(train, feats).select("feature", "var_rank")
    else:
        order = sorted((f for f in importance if f in feats), key=lambda f: -importance[f])
        rows = [(f, i + 1) for i, f in enumerate(order)]
        rank = train.sparkSession.createDataFrame(rows, "feature string, var_rank int")
    return cands.join(F.broadcast(rank), "feature", "inner")  # one row per feature


def find(instances: DataFrame, train: DataFrame, scorer, numeric: Sequence[str],
         categorical: Sequence[str], key: str = "id", top: int = 3, importance: dict[str, float] | None = None,
         scaler: DataFrame | None = None, target: int | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """Flips sorted by absolute change (ties: importance or variance rank, candidate order), top-k (K1).

    A flip is a change to any other class, or to the class ``target`` (instances that are of that class have none).

    ``importance`` (feature -> weight) replaces the variance order and leaves unnamed features unchanged;
    ``scaler`` (one row ``<f>__mean, <f>__std``) adds the values and the change in original units.
    ``num_found`` counts all flips of the instance; ``sketches``: see ``candidates``.
    """
    found = find_packed(instances, train, scorer, numeric, categorical, key, top, importance, target, sketches)
    out = found.select(key, "original_prediction", "num_found", F.posexplode("_c").alias("_i", "c"))
    out = out.select(key, (F.col("_i") + 1).alias("rank"), "c.feature", "c.original_value", "c.new_value", "c.change",
                     "original_prediction", "c.new_prediction", "num_found")
    if scaler is None:
        return out
    out = attach(out, scaler)

    def raw(c):
        e = F.col(c)
        for f in numeric:
            e = F.when(F.col("feature") == f, F.col(c) * F.col(f"{f}__std") + F.col(f"{f}__mean")).otherwise(e)
        return e
    out = out.withColumn("original_value_unscaled", raw("original_value")).withColumn("new_value_unscaled", raw("new_value"))
    return (out.withColumn("change_unscaled", F.abs(F.col("new_value_unscaled") - F.col("original_value_unscaled")))
            .drop(*[f"{f}__{k}" for f in numeric for k in ("mean", "std")]))


def find_packed(instances, train, scorer, numeric, categorical, key="id", top: int | None = 3, importance=None,
                target: int | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """One row per instance: its ``top`` flips as an array ``_c``, and ``num_found``."""
    cands = _ranked_candidates(train, list(scorer.features), candidates(train, numeric, categorical, sketches=sketches), importance)

    def flips(c, original):
        own = c["feature"].isin(*categorical) & (c["new_value"] == c["original_value"])
        reached = F.lit(True) if target is None else c["new_prediction"] == F.lit(target)
        return (c["new_prediction"] != original) & reached & ~own
    return _tried(instances, cands, scorer, key, flips, ("change", "var_rank", "cand_ord"), top)


def find_multiple(instances: DataFrame, train: DataFrame, scorer, numeric: Sequence[str],
                  categorical: Sequence[str], key: str = "id", n: int = 5) -> DataFrame:
    """First ``n`` flips in (feature, candidate) order, <= 3 values per feature (K2)."""
    feats = list(scorer.features)
    order = {f: float(len(feats) - i) for i, f in enumerate(feats)}
    cands = _ranked_candidates(train, feats, candidates(train, numeric, categorical, DIVERSE_QUANTILES), order)
    # categorical: the first three values other than the instance's own, so four candidates are enough
    cands = cands.where("cand_ord < 4")
    tried = _tried(instances, cands, scorer, key,
                   lambda c, _: ~(c["feature"].isin(*categorical) & (c["new_value"] == c["original_value"])),
                   ("var_rank", "cand_ord"), None)

    def of(feature):
        return F.slice(F.filter("_c", lambda c: c["feature"] == feature), 1, 3)
    first = F.flatten(F.array(*[of(f) for f in feats]))
    flips = F.slice(F.filter(first, lambda c: c["new_prediction"] != F.col("original_prediction")), 1, n)
    out = tried.select(key, F.posexplode(flips).alias("_i", "c"))
    return out.select(key, (F.col("_i") + 1).alias("rank"), F.lit("single_feature").alias("type"), "c.feature",
                      "c.original_value", "c.new_value", "c.new_prediction")


# fixed values: sentences of the explanation
NO_FLIP = "No simple single-feature change found to flip prediction."
ONE_FLIP = "To change prediction from %d to %d: Change %s from %.2f to %.2f"
NO_COUNTERFACTUAL = "No counterfactual explanation found."
TRY = "To flip the prediction, try: "


def explain_flip(found: DataFrame, key: str = "id") -> DataFrame:
    """One sentence per instance from the minimal flip, and one of its first three (K3), from ``find_packed``."""
    c = F.get("_c", F.lit(0))
    text = F.when(F.size("_c") == 0, F.lit(NO_FLIP)).otherwise(F.format_string(
        ONE_FLIP, F.col("original_prediction"), c["new_prediction"], c["feature"], c["original_value"], c["new_value"]))
    options = F.transform(F.slice("_c", 1, 3), lambda x, i: F.format_string(
        "%d. Change %s from %.2f to %.2f", i + 1, x["feature"], x["original_value"], x["new_value"]))
    top3 = F.when(F.size("_c") == 0, F.lit(NO_COUNTERFACTUAL)).otherwise(F.concat(F.lit(TRY), F.array_join(options, " OR ")))
    return found.select(key, text.alias("explanation"), top3.alias("top_explanation"))


def sensitivity_to_flip(instances: DataFrame, train: DataFrame, scorer,
                        numeric: Sequence[str], categorical: Sequence[str], key: str = "id") -> DataFrame:
    """Per feature: change needed to flip trying the training min, then max;
    categorical features count 1 when another value exists (K4)."""
    feats = list(scorer.features)
    ext = train.agg(*[e for f in numeric for e in (F.min(F.col(f).cast("double")).alias(f"{f}__min"),
                                                   F.max(F.col(f).cast("double")).alias(f"{f}__max"))],
                    *[F.countDistinct(f).alias(f"{f}__n") for f in categorical])
    j = scorer.apply(attach(instances.select(key, *[F.col(f).cast("double").alias(f) for f in feats]), ext),
                     p="_p0", pred="_op")
    for f in numeric:
        for k in ("min", "max"):
            j = scorer.apply(j, {f: F.col(f"{f}__{k}")}, p=f"_p_{f}_{k}", pred=f"_t_{f}_{k}")
    rows = []
    for f in numeric:
        lo, hi = F.col(f"{f}__min"), F.col(f"{f}__max")
        req = (F.when(F.col(f"_t_{f}_min") != F.col("_op"), F.abs(lo - F.col(f)))
               .when(F.col(f"_t_{f}_max") != F.col("_op"), F.abs(hi - F.col(f))))
        rows.append(F.struct(F.lit(f).alias("feature"), F.col(f).alias("current_value"),
                             req.cast("double").alias("required_change")))
    for f in categorical:
        # another value exists unless the training column has only the instance's value
        req = F.when(F.col(f"{f}__n") > 1, F.lit(1.0))
        rows.append(F.struct(F.lit(f).alias("feature"), F.col(f).alias("current_value"), req.alias("required_change")))
    pct = lambda c: F.when(c["current_value"] != 0, c["required_change"] / F.abs(c["current_value"]) * 100) \
        .otherwise(F.lit(0.0))
    ranked = F.array_sort(F.transform(F.filter(F.array(*rows), lambda c: c["required_change"].isNotNull()), lambda c: F.struct(
        c["required_change"].alias("required_change"), c["feature"].alias("feature"), c["current_value"].alias("current_value"),
        pct(c).alias("change_percentage"))))
    return (j.select(key, F.posexplode(ranked).alias("_i", "c"))
            .select(key, "c.feature", "c.current_value", "c.required_change", "c.change_percentage", (F.col("_i") + 1).alias("rank")))


def inverse_scale(instances: DataFrame, numeric: Sequence[str], ranges: DataFrame, scaler: DataFrame,
                  key: str = "id") -> DataFrame:
    """Scaled -> original units: the reference's +-3 sigma approximation and the exact
    inverse ``z * std + mean`` (K6)."""
    j = attach(attach(instances, ranges), scaler)
    rows = []
    for f in numeric:
        lo, hi, z = F.col(f"{f}__min"), F.col(f"{f}__max"), F.col(f).cast("double")
        approx = F.least(F.greatest(lo + (z + 3) * ((hi - lo) / 6), lo), hi)
        exact = z * F.col(f"{f}__std") + F.col(f"{f}__mean")
        rows.append(F.struct(F.lit(f).alias("feature"), z.alias("scaled_value"), approx.alias("approx_value"),
                             exact.alias("exact_value")))
    return j.select(key, F.inline(F.array(*rows)))
