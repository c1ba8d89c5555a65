"""Feature preparation: label encoding, scaling, deterministic stratified split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.functions.hashing import hash_hex
from arbiter.operators.common import attach, broadcast_if_small
from arbiter.operators.ordered import hash_rank, running_sums
from arbiter.operators.profile import categorical_columns, numeric_columns

# fixed values of the reference's preparation
TEST_SIZE = 0.2
SEED = 42
CLASSIFICATION_MAX_UNIQUE = 20     # distinct targets below this -> classification
POSITIVE_TOKENS = ("yes", "1", "true", "churn", "fraud", "positive")
MAX_CATEGORIES = 100_000           # encoder rows a column that are broadcast


def encoder_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``[feature, code, label]``: codes = rank of the sorted distinct strings from 0.

    Nulls are encoded as the string ``'nan'`` like ``astype(str)`` does.
    """
    cols = list(cols) if cols is not None else categorical_columns(df)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"),
                             F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("label"))
                    for c in cols])
    d = df.select(F.inline(arr)).distinct().withColumn("_one", F.lit(1))
    # ranks over buckets of the labels' beginnings: no task sorts all categories of a column
    r = running_sums(d, ["feature"], "label", ["_one"], bucket=F.substring("label", 1, 4),
                     include_ties=False, tie_breaker="label")
    return r.select("feature", (F.col("cum__one") - 1).cast("int").alias("code"), "label")


def label_encode(df: DataFrame, cols: Sequence[str] | None = None,
                 encoders: DataFrame | None = None) -> DataFrame:
    """Replace each categorical column by its code: one lookup per column, broadcast while the encoder
    table has at most ``MAX_CATEGORIES`` rows a column, a shuffled join beyond."""
    cols = list(cols) if cols is not None else categorical_columns(df)
    enc = encoders if encoders is not None else encoder_table(df, cols)
    most = MAX_CATEGORIES * max(len(cols), 1)
    small = enc.limit(most + 1).count() <= most
    out = df
    for c in cols:
        e = enc.where(F.col("feature") == c).select(F.col("label").alias(f"_l_{c}"),
                                                    F.col("code").alias(f"_c_{c}"))
        e = F.broadcast(e) if small else e  # size checked above
        key = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        out = (out.withColumn(f"_k_{c}", key).join(e, F.col(f"_k_{c}") == F.col(f"_l_{c}"), "left")
               .withColumn(c, F.col(f"_c_{c}")).drop(f"_k_{c}", f"_l_{c}", f"_c_{c}"))
    return out


def task_type(df: DataFrame, target: str) -> DataFrame:
    """classification if the target is a string or has < 20 distinct values."""
    is_str = dict(df.dtypes)[target] == "string"
    n = df.agg(F.countDistinct(target).alias("n_unique"))
    return n.select(F.when(F.lit(is_str) | (F.col("n_unique") < CLASSIFICATION_MAX_UNIQUE),
                           F.lit("classification")).otherwise(F.lit("regression")).alias("task_type"),
                    F.col("n_unique").cast("long").alias("n_unique"))


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row ``[<c>__mean, <c>__std]`` with population std (StandardScaler)."""
    return df.agg(*[e for c in cols for e in
                    (F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
                     F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std"))])


def standardize(df: DataFrame, cols: Sequence[str] | None = None,
                stats: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / std`` with std 0 -> 1 (F4); stats fitted on ``df`` unless given."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    st = stats if stats is not None else scaler_stats(df, cols)
    j = attach(df, st)
    for c in cols:
        s = F.col(f"{c}__std")
        j = j.withColumn(c, (F.col(c).cast("double") - F.col(f"{c}__mean"))
                         / F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s))
    return j.drop(*[f"{c}__{k}" for c in cols for k in ("mean", "std")])


def stratified_split(df: DataFrame, key: str = "id", label: str | None = "y",
                     test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Add ``split`` in {train, test}: per class the ``ceil(test_size * n)`` rows with
    the smallest ``md5(key:seed)`` go to test (F6).  ``label=None``: no strata.

    Ranks come from the two-level hash scan, so a class holding a third of
    the rows is still split over 4096 balanced window partitions.
    """
    part = [label] if label else []
    h = df.withColumn("_h", hash_hex(F.col(key), seed))
    j = hash_rank(h, part, "_h", key, "_rank", total_name="_n")
    is_test = F.col("_rank") <= F.ceil(F.col("_n") * F.lit(float(test_size)))
    return j.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_h", "_rank", "_n")


def feature_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``[feature, min, max]`` on the original scale."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    wide = df.agg(*[e for c in cols for e in (F.min(F.col(c).cast("double")).alias(f"{c}__min"),
                                              F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__min").alias("min"),
                              F.col(f"{c}__max").alias("max")) for c in cols])
    return wide.select(F.inline(rows))


def feature_stats(df: DataFrame, cols: Sequence[str] | None = None, population: bool = False) -> DataFrame:
    """``[feature, min, max, mean, std]`` - sample std on original data,
    population std on scaled data (F8)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    sd = F.stddev_pop if population else F.stddev_samp
    wide = df.agg(*[e for c in cols for e in (
        F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.max(F.col(c).cast("double")).alias(f"{c}__max"),
        F.avg(F.col(c).cast("double")).alias(f"{c}__mean"), sd(F.col(c).cast("double")).alias(f"{c}__std"))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{k}").alias(k)
                                                           for k in ("min", "max", "mean", "std")])
                     for c in cols])
    return wide.select(F.inline(rows))


def positive_label(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per target column: of exactly two distinct values, the first in sorted order whose lower-case
    form is a positive token; else the first sorted value (F11)."""
    arr = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("value"))
                    for t in targets])
    d = df.select(F.inline(arr)).where(F.col("value").isNotNull()).distinct()
    hit = F.lower(F.col("value")).isin(*POSITIVE_TOKENS)
    g = d.groupBy("target").agg(F.min(F.when(hit, F.col("value"))).alias("_hit"),
                                F.min("value").alias("_first"), F.count(F.lit(1)).alias("_n"))
    g = g.withColumn("_hit", F.when(F.col("_n") == 2, F.col("_hit")))
    return g.select("target", F.coalesce("_hit", "_first").alias("positive_label"),
                    F.col("_hit").isNotNull().alias("inferred"))


def prepare(df: DataFrame, target: str, key: str = "id", test_size: float = TEST_SIZE,
            fit_on: str = "train", seed: int = SEED) -> DataFrame:
    """Encode -> split -> scale (F5).  ``fit_on="all"`` fits the scaler before the
    split like the reference; the default fits on the training rows only."""
    cats = categorical_columns(df, exclude=[target, key])
    nums = numeric_columns(df, exclude=[target, key])
    enc = label_encode(df, cats)
    # stratify for classification targets only (one bounded count)
    is_cls = task_type(df, target).first()["task_type"] == "classification"
    split = stratified_split(enc, key, target if is_cls else None, test_size, seed)
    fit_src = split if fit_on == "all" else split.where(F.col("split") == "train")
    return standardize(split, nums, scaler_stats(fit_src, nums))


def encode_target(df: DataFrame, target: str, positive: str | None = None, out: str = "y") -> DataFrame:
    """Binary target -> 0/1 (F2).  The positive label is given, or inferred with
    :func:`positive_label` (a one-row result, broadcast back); nulls stay null."""
    t = F.col(target).cast("string")
    if positive is not None:
        return df.withColumn(out, F.when(t.isNull(), F.lit(None)).otherwise((t == F.lit(positive)).cast("int")))
    pos = positive_label(df, [target]).select(F.col("positive_label").alias("_pos"))
    j = attach(df, pos)
    return j.withColumn(out, F.when(t.isNull(), F.lit(None)).otherwise((t == F.col("_pos")).cast("int"))) \
        .drop("_pos")


def scaler_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``[feature, mean, std]`` of the fitted scaler."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std")) for c in cols])
    return scaler_stats(df, cols).select(F.inline(rows))


def factorize(df: DataFrame, col: str, key: str, out: str = "code") -> DataFrame:
    """Codes 0, 1, .. in the order of each value's first key; null is -1."""
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.min(key).alias("_k")).withColumn("_one", F.lit(1))
    codes = running_sums(first, [], "_k", ["_one"], include_ties=False, tie_breaker="_v")
    codes = broadcast_if_small(codes.select("_v", (F.col("cum__one") - 1).cast("int").alias(out)))
    return df.join(codes, df[col] == F.col("_v"), "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(-1)))


def yes_no(c) -> F.Column:
    """Yes / No as 1 / 0; other values as integers where they are, else null."""
    return F.when(c == "Yes", 1).when(c == "No", 0).otherwise(c.cast("string").try_cast("int"))
