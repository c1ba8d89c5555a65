"""What-if scenarios: partial feature inputs -> model rows -> predictions.

Scenarios are a long table ``[scenario_id, feature, value STRING]``; many
scenarios are built and scored in one pass (the reference scores one
scenario per call).  Raw user units are scaled with the training scaler
(fixing the reference's raw-into-scaled write; ``prescaled=True`` skips it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.operators.common import attach, broadcast_if_small


def linspace(lo, hi, n: int, i):
    """NumPy ``linspace`` element ``i`` (endpoint exact)."""
    step = (hi - lo) / F.lit(float(n - 1))
    return F.when(i == n - 1, hi).otherwise(lo + i * step)


def build_rows(scenarios: DataFrame, features: Sequence[str], numeric: Sequence[str],
               categorical: Sequence[str], defaults: DataFrame, scaler: DataFrame,
               encoders: DataFrame, prescaled: bool = False) -> DataFrame:
    """Model-space rows per scenario.

    defaults: one row ``<f>__default`` (training means in model space);
    scaler: one row ``<f>__mean, <f>__std`` (raw units);
    encoders: ``[feature, code, label]``.  Null / blank values are ignored,
    unseen categories get code 0, unparsable numbers are ignored.
    """
    v = F.trim(F.col("value"))
    valid = F.col("value").isNotNull() & (v != "")
    # one aggregation over all rows: a scenario whose every value is ignored
    # still forms its group and gets the defaults
    wide = scenarios.groupBy("scenario_id").agg(
        *[F.max(F.when((F.col("feature") == f) & valid, F.col("value"))).alias(f"_in_{f}") for f in features])
    out = attach(attach(wide, defaults), scaler)
    enc = broadcast_if_small(encoders)
    for f in categorical:
        e = enc.where(F.col("feature") == f).select(F.col("label").alias(f"_l_{f}"), F.col("code").alias(f"_c_{f}"))
        out = out.join(e, F.trim(F.col(f"_in_{f}")) == F.col(f"_l_{f}"), "left")
    cols = []
    for f in features:
        if f in categorical:
            val = F.when(F.col(f"_in_{f}").isNull(), F.col(f"{f}__default")) \
                .otherwise(F.coalesce(F.col(f"_c_{f}").cast("double"), F.lit(0.0)))
        else:
            raw = F.trim(F.col(f"_in_{f}")).try_cast("double") if hasattr(F.Column, "try_cast") \
                else F.expr(f"try_cast(trim(_in_{f}) AS DOUBLE)")
            if f in numeric and not prescaled:
                sd = F.col(f"{f}__std")
                raw = (raw - F.col(f"{f}__mean")) / F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
            val = F.coalesce(raw, F.col(f"{f}__default"))
        cols.append(val.alias(f))
    return out.select("scenario_id", *cols)


def onehot(scenarios: DataFrame, feature: str, categories: Sequence[str]) -> DataFrame:
    """One-hot columns ``<feature>_<category>`` for a scenario's category (W2);
    an unseen category leaves all zeros."""
    s = scenarios.where(F.col("feature") == feature)
    return s.select("scenario_id", *[(F.trim(F.col("value")) == F.lit(c)).cast("int").alias(f"{feature}_{c}")
                                     for c in categories]).na.fill(0)


def onehot_rows(scenarios: DataFrame, rows: DataFrame, numeric: Sequence[str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """Rows for a ``OneHotScorer``: the numeric features of ``rows`` (from ``build_rows``) and every group's one-hot columns."""
    out = rows.select("scenario_id", *numeric)
    for f, categories in groups.items():
        out = out.join(onehot(scenarios, f, categories), "scenario_id", "left").na.fill(0, [f"{f}_{c}" for c in categories])
    return out


def predict(rows: DataFrame, scorer) -> DataFrame:
    """Prediction and max-class confidence per scenario."""
    out = scorer.apply(rows, p="_p", pred="prediction")
    return out.select("scenario_id", F.lit(scorer.name).alias("model"), "prediction", _confidence(scorer).alias("confidence"))


def _confidence(scorer):
    p = F.col("_p")  # with more than two classes already the highest probability
    return p if scorer.n_classes > 2 else F.greatest(p, 1 - p)


def predict_classes(rows: DataFrame, scorer) -> DataFrame:
    """Every class's probability per scenario, the most probable first (W3): ``[scenario_id, model, class, probability, rank]``."""
    out = scorer.apply_classes(rows, prob="_prob").select("scenario_id", F.lit(scorer.name).alias("model"), F.col("_prob"))
    order = F.array_sort(F.transform("_prob", lambda p, k: F.struct((-p).alias("n"), k.alias("class"), p.alias("probability"))))
    out = out.select("scenario_id", "model", F.posexplode(order).alias("_i", "c"))
    return out.select("scenario_id", "model", "c.class", "c.probability", (F.col("_i") + 1).alias("rank"))


def compare(rows: DataFrame, scorers: Sequence) -> DataFrame:
    """Every model for every scenario (W4).  Columnar scorers are exploded per row, no join;
    each fitted model adds its own pass."""
    arr = [F.struct(F.lit(s.name).alias("model"), s.pred().alias("prediction"),
                    (s.p() if s.n_classes > 2 else F.greatest(s.p(), 1 - s.p())).alias("confidence")) for s in scorers if s.columnar]
    parts = [rows.select("scenario_id", F.inline(F.array(*arr)))] if arr else []
    parts += [predict(rows, s) for s in scorers if not s.columnar]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sensitivity(rows: DataFrame, scorer, feature: str, lo, hi, n: int,
                scaler_row: DataFrame | None = None) -> DataFrame:
    """Vary one feature over ``linspace(lo, hi, n)`` in raw units for every scenario."""
    g = attach(rows, scaler_row) if scaler_row is not None else rows
    g = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    raw = linspace(F.lit(float(lo)) if not hasattr(lo, "alias") else lo,
                   F.lit(float(hi)) if not hasattr(hi, "alias") else hi, n, F.col("step"))
    scaled = raw
    if scaler_row is not None:
        sd = F.col(f"{feature}__std")
        scaled = (raw - F.col(f"{feature}__mean")) / F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
    g = scorer.apply(g.withColumn("_raw", raw), {feature: scaled}, p="_p", pred="prediction")
    return g.select("scenario_id", "step", F.col("_raw").alias("feature_value"), "prediction",
                    _confidence(scorer).alias("confidence"))


def recommend(rows: DataFrame, scorer, target: int, ranges: DataFrame,
              scaler_row: DataFrame, variable: Sequence[str], n: int = 5) -> DataFrame:
    """Scenarios reaching ``target`` by varying up to two numeric features over
    ``linspace(min, max, n)``; first ``n`` per scenario in (feature, step) order (W6)."""
    variable = list(variable)[:2]
    g = attach(attach(rows, scaler_row), ranges)
    if scorer.columnar:  # the grid stays inside the row: no explode before the hits are known
        tries = []
        for j, f in enumerate(variable):
            sd = F.col(f"{f}__std")
            sd = F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
            for i in range(n):
                val = linspace(F.col(f"{f}__min"), F.col(f"{f}__max"), n, F.lit(i))
                tries.append(F.struct(F.lit(f).alias("feature"), val.alias("value"),
                                      scorer.pred({f: (val - F.col(f"{f}__mean")) / sd}).alias("pred")))
        hits = F.slice(F.filter(F.array(*tries), lambda t: t["pred"] == F.lit(target)), 1, n)
        return (g.select("scenario_id", F.posexplode(hits).alias("rank", "t"))
                .select("scenario_id", (F.col("rank") + 1).alias("rank"), "t.feature", "t.value"))
    grid = F.array(*[F.struct(F.lit(j).alias("fi"), F.lit(f).alias("feature"), F.lit(i).alias("step"))
                     for j, f in enumerate(variable) for i in range(n)])
    g = g.select("*", F.inline(grid))
    raw = None
    for f in variable:
        val = linspace(F.col(f"{f}__min"), F.col(f"{f}__max"), n, F.col("step"))
        raw = F.when(F.col("feature") == f, val) if raw is None else raw.when(F.col("feature") == f, val)
    g = g.withColumn("_raw", raw)
    cols = {}
    for f in variable:
        sd = F.col(f"{f}__std")
        sc = (F.col("_raw") - F.col(f"{f}__mean")) / F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
        cols[f] = F.when(F.col("feature") == f, sc).otherwise(F.col(f))
    hits = scorer.apply(g, cols, p="_p", pred="_pred").where(F.col("_pred") == F.lit(target))
    w = Window.partitionBy("scenario_id").orderBy("fi", "step")  # at most 2n rows per scenario
    return (hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("scenario_id", "rank", "feature", F.col("_raw").alias("value")))
