"""Data-quality checks: target leakage, train/test drift (two-sample KS), class
imbalance, missing values, outliers, and the combined report.

Every check handles all numeric features in one aggregation (features are
melted to ``[feature, value]`` where a per-feature ordering is needed).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators.common import attach
from arbiter.operators.ordered import running_sums
from arbiter.operators.profile import melt_numeric

# fixed values: thresholds and recommendation texts of the checks
LEAK_CRITICAL, LEAK_HIGH = 0.9, 0.8
DRIFT_P = 0.05
OUTLIER_Z = 3.0
KS_TERMS = 100
EXACT_KS = 10_000
REC_LEAK = "⚠️ Potential target leakage detected! Review suspicious features before using model."
REC_LEAK_OK = "✅ No obvious target leakage detected."
REC_DRIFT = "⚠️ Distribution drift detected! Model performance may degrade on new data."
REC_DRIFT_OK = "✅ No significant distribution drift detected."
REC_IMB = "⚠️ Severe class imbalance detected! Consider resampling or cost-weighting."
REC_IMB_OK = "✅ Acceptable class balance."
REC_MISS = "⚠️ Significant missing values detected! Ensure preprocessing handles them correctly."
REC_MISS_OK = "✅ Missing values are minimal."
REC_OUT = "✓ Check outliers, but they may be legitimate domain values."
REC_OUT_OK = "✅ No significant outliers detected."
ISSUE_LEAK = "⚠️ Target leakage detected"
ISSUE_DRIFT = "⚠️ Distribution drift detected"
ISSUE_IMB = "⚠️ Severe class imbalance"
ISSUE_MISS = "⚠️ Significant missing values"


def _stats_long(df: DataFrame, cols: Sequence[str], stats: dict) -> DataFrame:
    wide = df.agg(*[fn(c).alias(f"{c}__{s}") for c in cols for s, fn in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ordinal"),
                              *[F.col(f"{c}__{s}").alias(s) for s in stats])
                     for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def mean_filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls replaced by the column mean (one aggregation, broadcast back)."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}__m") for c in cols])
    j = attach(df, means)
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"{c}__m")))
    return j.drop(*[f"{c}__m" for c in cols])


def leakage(df: DataFrame, cols: Sequence[str], label: str = "y",
            threshold: float = LEAK_CRITICAL, key: str = "id") -> DataFrame:
    """Features whose |Pearson r| with the target (mean-filled) exceeds 0.8 / 0.9 (Q1).

    A string target is factorised in the order of ``key`` first.
    """
    if dict(df.dtypes)[label] == "string":
        from arbiter.operators.prep import factorize
        df = factorize(df, label, key, "_code").drop(label).withColumnRenamed("_code", label)
    f = mean_filled(df, cols)
    y = F.col(label).cast("double")
    # a constant column has no correlation (null), whatever the engine's rule for division by zero
    c = _stats_long(f, cols, {"r": lambda c: F.try_divide(F.covar_pop(F.col(c), y), F.stddev_pop(
        F.when(y.isNotNull(), F.col(c))) * F.stddev_pop(F.when(F.col(c).isNotNull(), y)))})
    a = F.abs(F.col("r"))
    risk = F.when(a > threshold, "CRITICAL").when(a > LEAK_HIGH, "HIGH")
    return (c.where(F.col("r").isNotNull() & ~F.isnan("r")).select("feature", a.alias("correlation_with_target"),
                                                                   risk.alias("risk_level"))
            .where(F.col("risk_level").isNotNull()))


def ks_pvalue(d, en) -> F.Column:
    """Kolmogorov asymptotic p-value ``Q(lambda)``, ``lambda = D sqrt(n m / (n + m))``.

    The alternating series ``2 sum (-1)^(k-1) exp(-2 k^2 lambda^2)`` only
    converges for larger lambda; below 1.18 the equivalent form
    ``1 - sqrt(2 pi) / lambda * sum exp(-(2k-1)^2 pi^2 / (8 lambda^2))`` is used.
    """
    lam = d * F.sqrt(en)
    ks = F.sequence(F.lit(1), F.lit(KS_TERMS))
    large = 2 * F.aggregate(ks, F.lit(0.0),
                            lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    small = 1 - F.try_divide(F.sqrt(F.lit(2 * math.pi)), lam) * F.aggregate(
        ks, F.lit(0.0), lambda acc, k: acc + F.coalesce(F.exp(F.try_divide(
            -((2 * k - 1) * (2 * k - 1)) * F.lit(math.pi ** 2), 8 * lam * lam)), F.lit(0.0)))
    p = F.when(lam < 1e-3, F.lit(1.0)).when(lam < 1.18, small).otherwise(large)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def exact_ks(d: float, n1: int, n2: int) -> float:
    """P(D >= d) of two samples of sizes n1 and n2 from one continuous distribution, exactly.

    The merged order of the samples is a lattice path from (0, 0) to (n1, n2), all paths equally likely.  The
    probability of having stayed where the two distribution functions differ by less than d is carried from
    diagonal to diagonal; what steps out is summed, so small probabilities keep their digits.
    """
    g = math.gcd(n1, n2)
    reach = round(d * (n1 // g) * n2) * g  # in units of 1 / (n1 n2)
    if reach == 0:
        return 1.0
    n, low, inside, outside = n1 + n2, 0, np.ones(1), 0.0
    for s in range(n):
        i = low + np.arange(len(inside))
        step = np.zeros(len(inside) + 1)
        step[1:] = inside * ((n1 - i) / (n - s))
        step[:-1] += inside * ((n2 - s + i) / (n - s))
        first = max(low, ((s + 1) * n1 - reach) // n + 1)
        last = min(low + len(inside), -(-((s + 1) * n1 + reach) // n) - 1)
        kept = step[first - low:max(last - low + 1, first - low)]
        outside += step[:first - low].sum() + step[first - low + len(kept):].sum()
        inside, low = kept, first
        if not len(inside):
            break
    return min(float(outside), 1.0)


def ks_pvalue_of(d, n1, n2, exact_up_to: int = EXACT_KS) -> F.Column:
    """Two-sided p-value: exact while both sides have at most ``exact_up_to`` rows, asymptotic beyond."""
    @F.pandas_udf("double")
    def exact(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        small = d.notna() & (n1 > 0) & (n2 > 0) & (np.maximum(n1, n2) <= exact_up_to)
        return pd.Series([exact_ks(x, int(a), int(b)) if ok else float("nan") for x, a, b, ok in zip(d, n1, n2, small)], dtype=float)
    series = ks_pvalue(d, F.try_divide(n1 * n2, n1 + n2))
    return F.when(d.isNotNull(), F.when(F.greatest(n1, n2) <= exact_up_to, exact(d, n1, n2)).otherwise(series))


def drift(train: DataFrame, test: DataFrame, cols: Sequence[str],
          p_threshold: float = DRIFT_P, by: Sequence[str] = (), exact_up_to: int = EXACT_KS) -> DataFrame:
    """Two-sample KS per numeric feature (and group ``by``), each side mean-filled by its own mean (Q2).

    D is exact: values are counted per (feature, value), a side's missing values are as many copies of its mean, and
    the two empirical CDFs are running sums over the two-level ordered scan.  Each side is melted once; its counts,
    means and deviations come from one aggregation.  A feature without a value on a side has no D and no p.
    The p-value is exact for up to ``exact_up_to`` rows a side.
    """
    by = list(by)
    part = [*by, "feature"]
    parts = [melt_numeric(df, cols, by).withColumnRenamed("column_name", "feature").withColumn("_s", F.lit(s))
             for s, df in enumerate((train, test))]
    both = parts[0].unionByName(parts[1])
    both = both.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    stats = both.groupBy(*part, "_s").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("m"), F.avg("value").alias("mean"),
                                          F.stddev_samp("value").alias("std"))
    # copies of the mean add no squared deviation
    filled = F.when(F.col("m") == 1, F.lit(0.0)).otherwise(F.col("std") * F.sqrt(F.try_divide(F.col("m") - 1, F.col("n") - 1)))
    filled = F.when(F.col("n") > 1, filled)

    def side(s, e, name):
        return F.max(F.when(F.col("_s") == s, e)).alias(name)
    wide = stats.groupBy(*part).agg(side(0, F.col("mean"), "train_mean"), side(1, F.col("mean"), "test_mean"), side(0, filled, "train_std"),
                                    side(1, filled, "test_std"), side(0, F.col("n"), "n1"), side(1, F.col("n"), "n2"))
    # a side's missing values are one row, with their number; all rows meet in one shuffle
    one = [F.when(F.col("_s") == s, F.col("_k")).otherwise(F.lit(0)).cast("long").alias(c) for s, c in ((0, "a"), (1, "b"))]
    copies = stats.where((F.col("n") > F.col("m")) & F.col("mean").isNotNull()).select(*part, "_s", F.col("mean").alias("value"), (F.col("n") - F.col("m")).alias("_k"))
    cells = both.where("value is not null").withColumn("_k", F.lit(1).cast("long")).unionByName(copies).select(*part, "value", *one)
    counts = cells.groupBy(*part, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cum = running_sums(counts, part, "value", ["a", "b"], totals=True)
    gap = F.abs(F.try_divide("cum_a", "tot_a") - F.try_divide("cum_b", "tot_b"))
    ks = cum.groupBy(*part).agg(F.max(gap).alias("ks_statistic"))
    same = F.lit(True)
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    out = wide.join(ks.withColumnsRenamed({c: f"_j_{c}" for c in part}), same, "left")
    p = ks_pvalue_of(F.col("ks_statistic"), F.col("n1"), F.col("n2"), exact_up_to)
    return out.select(*part, "ks_statistic", p.alias("p_value"), "train_mean", "test_mean", "train_std",
                      "test_std", (p < p_threshold).alias("drifted"))


def class_imbalance(df: DataFrame, label: str = "y") -> DataFrame:
    """Class counts, max/min ratio, Low < 2 <= Medium < 5 <= High (Q3)."""
    c = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    # the counts' own shuffle is used twice; a label may have many values
    c = attach(c, c.agg((F.max("count") / F.min("count")).alias("imbalance_ratio")))
    sev = (F.when(F.col("imbalance_ratio") < 2, "Low").when(F.col("imbalance_ratio") < 5, "Medium")
           .otherwise("High"))
    return c.select("class", "count", "imbalance_ratio", sev.alias("severity"))


def missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Features with missing values: count, %, High > 50 >= Medium > 10 >= Low; plus the
    share of all missing cells (Q4)."""
    cols = list(cols) if cols is not None else df.columns
    def miss(c):
        m = F.col(c).isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        return F.count(F.when(m, 1))
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[miss(c).alias(f"{c}__m") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("missing_count")) for c in cols])
    s = wide.select("n_rows", F.inline(rows))
    pct = F.try_divide(F.col("missing_count"), F.col("n_rows")) * 100
    s = s.select("feature", F.col("missing_count").cast("long").alias("missing_count"),
                 pct.alias("missing_percentage"),
                 F.when(pct > 50, "High").when(pct > 10, "Medium").otherwise("Low").alias("severity"),
                 "n_rows")
    tot = s.agg((F.try_divide(F.sum("missing_count"), F.first("n_rows") * F.lit(len(cols))) * 100)
                .alias("total_missing_percentage"))
    return attach(s.where(F.col("missing_count") > 0).drop("n_rows"), tot)


def outliers(df: DataFrame, cols: Sequence[str], z: float = OUTLIER_Z) -> DataFrame:
    """Per numeric feature: rows with |z| > 3 on mean-filled data, sample std (Q5).

    The filled column's sample variance follows from the non-null variance
    (filled cells add zero deviation), so only two passes are needed.
    """
    n = F.count(F.lit(1))
    st = df.agg(n.alias("_n"), *[e for c in cols for e in (
        F.avg(F.col(c).cast("double")).alias(f"{c}__m"),
        F.var_samp(F.col(c).cast("double")).alias(f"{c}__v"),
        F.count(F.col(c)).alias(f"{c}__k"))])
    j = attach(df, st)
    aggs = []
    for c in cols:
        sd = F.sqrt(F.try_divide(F.col(f"{c}__v") * (F.col(f"{c}__k") - 1), F.col("_n") - 1))
        x = F.coalesce(F.col(c).cast("double"), F.col(f"{c}__m"))
        aggs.append(F.sum(F.when(F.abs(F.try_divide(x - F.col(f"{c}__m"), sd)) > z, 1).otherwise(0))
                    .cast("long").alias(f"{c}__o"))
    wide = j.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__o").alias("outlier_count"))
                     for c in cols])
    long = wide.select("_n", F.inline(rows))
    return long.where(F.col("outlier_count") > 0).select(
        "feature", "outlier_count", (F.try_divide(F.col("outlier_count"), F.col("_n")) * 100).alias("outlier_percentage"))


def report(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str = "y") -> DataFrame:
    """One row: finding counts, quality score ``max(0, 100 - 10 x findings)``,
    its band and the recommendations of every check (Q6, Q8)."""
    lk = leakage(train, cols, label).agg(F.count(F.lit(1)).alias("leakage_findings"))
    dr = drift(train, test, cols).agg(F.sum(F.col("drifted").cast("int")).alias("drift_findings"))
    ou = outliers(train, cols).agg(F.count(F.lit(1)).alias("outlier_findings"))
    im = class_imbalance(train, label).agg(F.first("severity").alias("imbalance_severity"))
    feat_cols = [c for c in train.columns if c != label]
    mtr = missing(train.select(*feat_cols)).agg(F.max("total_missing_percentage").alias("m_tr"))
    mte = missing(test.select(*feat_cols)).agg(F.max("total_missing_percentage").alias("m_te"))
    r = attach(attach(attach(attach(attach(lk, dr), ou), im), mtr), mte)
    r = r.withColumn("drift_findings", F.coalesce("drift_findings", F.lit(0)).cast("long"))
    issues = F.col("leakage_findings") + F.col("drift_findings") + F.col("outlier_findings")
    score = F.greatest(F.lit(0), F.lit(100) - issues * 10).cast("double")
    band = F.when(score > 75, "green").when(score > 50, "yellow").otherwise("red")
    warn = F.concat_ws("\n",
                       F.when(F.col("leakage_findings") > 0, REC_LEAK).otherwise(REC_LEAK_OK),
                       F.when(F.col("drift_findings") > 0, REC_DRIFT).otherwise(REC_DRIFT_OK),
                       F.when(F.col("imbalance_severity") == "High", REC_IMB).otherwise(REC_IMB_OK),
                       F.when(F.coalesce("m_tr", F.lit(0.0)) > 5, REC_MISS).otherwise(REC_MISS_OK),
                       F.when(F.coalesce("m_te", F.lit(0.0)) > 5, REC_MISS).otherwise(REC_MISS_OK),
                       F.when(F.col("outlier_findings") > 0, REC_OUT).otherwise(REC_OUT_OK))
    return r.select("leakage_findings", "drift_findings", "outlier_findings", "imbalance_severity",
                    F.coalesce("m_tr", F.lit(0.0)).alias("train_missing_percentage"),
                    score.alias("quality_score"), band.alias("score_band"), warn.alias("warnings"))


def summary(rep: DataFrame) -> DataFrame:
    """Human-readable summary line(s) from :func:`report` (Q7)."""
    issues = F.concat_ws("\n",
                         F.when(F.col("leakage_findings") > 0, F.lit(ISSUE_LEAK)),
                         F.when(F.col("drift_findings") > 0, F.lit(ISSUE_DRIFT)),
                         F.when(F.col("imbalance_severity") == "High", F.lit(ISSUE_IMB)),
                         F.when(F.col("train_missing_percentage") > 5, F.lit(ISSUE_MISS)))
    s = F.format_string("%.0f", F.col("quality_score"))
    text = F.when(issues == "", F.concat(F.lit("✅ Data quality looks good (Score: "), s, F.lit("/100)"))) \
        .otherwise(F.concat(F.lit("⚠️ Data quality issues found (Score: "), s, F.lit("/100):\n"), issues))
    return rep.select("quality_score", text.alias("summary"))
