"""Model registry and model-card tables, with training facts computed from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the seven card sections
CARD_SECTIONS = ("model_details", "intended_use", "training_data", "performance", "limitations",
                 "ethical_considerations", "recommendations")


def metadata(metrics: DataFrame, model_types: dict[str, str], task: str, trained_at: DataFrame,
             features: Sequence[str]) -> DataFrame:
    """``[model, model_type, task, trained_at, <metrics>, feature_names, feature_count]``."""
    types = F.create_map(*[e for k, v in model_types.items() for e in (F.lit(k), F.lit(v))])
    from arbiter.operators.common import attach
    return attach(metrics, trained_at).select(
        "model", types[F.col("model")].alias("model_type"), F.lit(task).alias("task"), "trained_at",
        *[c for c in metrics.columns if c != "model"],
        F.lit(",".join(features)).alias("feature_names"), F.lit(len(features)).alias("feature_count"))


def card(meta: DataFrame, facts: DataFrame, texts: dict[str, dict[str, str]]) -> DataFrame:
    """One card row per model: computed facts plus the written sections.

    ``texts[model][section]`` holds the free-text sections; a section absent
    from every source stays absent (see :func:`completeness`).
    """
    from arbiter.operators.common import attach
    j = attach(meta, facts)
    sec = {}
    for s in CARD_SECTIONS:
        given = F.create_map(*[e for m, t in texts.items() if s in t for e in (F.lit(m), F.lit(t[s]))]) \
            if any(s in t for t in texts.values()) else None
        sec[s] = given[F.col("model")] if given is not None else F.lit(None).cast("string")
    sec["model_details"] = F.concat_ws(" ", F.col("model"), F.col("model_type"))
    sec["training_data"] = F.format_string("%d rows, %d train / %d test (%.0f%% test), %d features",
                                           F.col("n_rows"), F.col("n_train"), F.col("n_test"),
                                           F.col("n_test") / F.col("n_rows") * 100, F.col("feature_count"))
    sec["performance"] = F.format_string("accuracy %.4f, f1 %.4f, roc_auc %.4f",
                                         F.col("accuracy"), F.col("f1"), F.col("roc_auc"))
    pairs = [e for s in CARD_SECTIONS for e in (F.lit(s), sec[s])]
    return j.select("model", "model_type", "n_rows", "n_train", "n_test", "feature_count",
                    *[sec[s].alias(s) for s in CARD_SECTIONS],
                    F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("sections"))


def completeness(cards: DataFrame) -> DataFrame:
    """Sections present / missing of seven and % complete (R2)."""
    req = F.array(*[F.lit(s) for s in CARD_SECTIONS])
    missing = F.array_sort(F.array_except(req, F.map_keys("sections")))
    present = F.size(req) - F.size(missing)
    return cards.select("model", present.alias("sections_present"),
                        F.array_join(missing, ",").alias("sections_missing"),
                        (present / F.lit(len(CARD_SECTIONS)) * 100).alias("completeness_pct"))


def register(meta: DataFrame, path: str) -> str:
    """Append metadata rows to the registry table (M10); registrations are ordered by ``trained_at``."""
    meta.write.mode("append").parquet(path)
    return path


def history(spark, path: str, model: str | None = None) -> DataFrame:
    """All registrations, or those of one model, the latest first."""
    df = spark.read.parquet(path)
    return (df.where(F.col("model") == model) if model else df).orderBy(F.col("trained_at").desc(), "model")


def latest(spark, path: str) -> DataFrame:
    """The last registration of each model."""
    df = spark.read.parquet(path)
    row = F.max_by(F.struct(*df.columns), "trained_at").alias("r")
    return df.groupBy("model").agg(row).select("r.*")
