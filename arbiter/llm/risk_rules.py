"""Quality rules with risk-controlled cutoffs.

Every document gets structure statistics (``text_statistics``).  A rule rejects a document whose
statistic exceeds a cutoff.  ``certify`` chooses the cutoffs on labelled rows so that good documents
are rejected rarely, with a guarantee per stratum:

* the false-rejection limit ``alpha`` is divided evenly among the rules, so the union of the rules
  keeps within ``alpha``;
* for each (stratum, rule), the cutoffs of a fixed grid are tested from the laxest on: the hypothesis
  "this cutoff rejects more than alpha / rules of the good documents" is rejected if the exact binomial
  probability of at most the seen number of false rejections is at most ``delta / (strata * rules)``
  (Bonferroni over strata and rules, the one-sided Clopper-Pearson bound).  The sequence stops at the
  first cutoff that fails, so no further correction over the cutoffs is needed (fixed-sequence testing);
* the strictest certified cutoff is used; a (stratum, rule) with none never rejects, and a rule that
  rejects no bad labelled document of its stratum is left off.

Strata without their own certified rows (unseen values too) reject by the base rule only.

Nulls and odd input: a null text has no words; null strata are the stratum ``(none)``; labelled rows
with a null label or an id that no document has are ignored; repeated document rows are each scored,
and each counts in the holdout; an empty label table certifies nothing, so only the base rule rejects.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm import words as W
from arbiter.llm.registry import query
from arbiter.llm.tables import broadcast_checked, by_slices, load, materialize, one_label

STATS = ("doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, n_lines long, n_upper long, n_letters long, n_marks long")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, LETTER, MARK = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = True
LETTER[0xC3:0xF5] = True  # lead bytes of other letters
MARK[list(b"!?")] = True
WINDOW = 5


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


#: Rule name -> (statistic, grid of cutoffs from the laxest to the strictest).
RULES: dict[str, tuple[Column, list[float]]] = {}


def rules() -> dict[str, tuple[Column, list[float]]]:
    """The production rules; the grids are fixed in advance, never fitted to the data."""
    if not RULES:
        share = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]
        RULES.update({
            "symbols": (_share("n_symbols", "word_chars"), share),
            "dup_lines": (_share("n_dup_lines", "n_lines"), share),
            "repeats": (_share("n_repeat_words", "n_words"), share),
            "upper": (_share("n_upper", "n_letters"), share),
            "marks": (_share("n_marks", "n_words"), share),
            "word_length": (_share("word_chars", "n_words"), [30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0]),
        })
    return RULES


def structure(w: W.Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every row of a slice, from its words and their hashes."""
    data, off, n = w.data, w.offsets, len(w.counts)
    word = ~W.SPACE[data]
    repeated = np.zeros(len(h), bool)
    hs, at = W.windows(h, w.row, WINDOW)
    if len(hs):
        key = W.mix(hs + w.row[at].astype(np.uint64) * W._STEP)
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        hit = at[order[same]]
        if len(hit):
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            repeated = np.cumsum(edge[:-1]) > 0
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        ls = [x for x in w.text(i).split(b"\n") if x.strip()]
        lines[i], dup[i] = len(ls), len(ls) - len(set(ls))
    return {
        "n_words": w.counts, "word_chars": W.per_row(word & ((data & 0xC0) != 0x80), off), "n_symbols": W.per_row(SYMBOLS[data], off),
        "n_dup_lines": dup, "n_repeat_words": np.bincount(w.row, weights=repeated, minlength=n)[:n].astype(np.int64),
        "n_lines": lines, "n_upper": W.per_row(UPPER[data], off), "n_letters": W.per_row(LETTER[data], off), "n_marks": W.per_row(MARK[data], off)}


def _statistics(b: pa.RecordBatch) -> pa.RecordBatch:
    w = W.split(b.column(2))
    s = structure(w, W.hashes(w))
    names = [x.split()[0] for x in STATS.split(", ")]
    return pa.record_batch([b.column(0), b.column(1), *[pa.array(s[x]) for x in names[2:]]], names=names)


def text_statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row a document: the base counts and the statistics that the rules use."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col(stratum).cast("string"), F.lit("(none)")).alias("stratum"),
                      F.col("text").alias("text"))
    stats = by_slices(src, "text", _statistics, STATS)
    return stats.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed in logarithms."""
    if n == 0:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
             for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certify(stats: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05,
            rule_set: dict | None = None) -> DataFrame:
    """Certified cutoffs: (stratum, rule, cutoff, n_good, false_rejected, p_value).

    The counts per (stratum, rule, cutoff) come from one aggregation over all labelled rows; each group
    of the second step holds one grid.
    """
    rule_set = rule_set or rules()
    good = one_label(labels, "quality")
    steps = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (stat > c).alias("rejects"))
        for name, (stat, grid) in rule_set.items() for i, c in enumerate(grid)])
    seen = (stats.where("not base_failed").join(good, F.col("doc_id") == F.col("_key"))
            .select("stratum", F.col("_label"), F.explode(steps).alias("s")).select("stratum", "_label", "s.*"))
    counts = (seen.groupBy("stratum", "rule", "step", "cutoff")
              .agg(F.count(F.expr("case when _label = 1 then 1 end")).alias("n_good"),
                   F.count(F.expr("case when _label = 1 and rejects then 1 end")).alias("false_rejected"),
                   F.count(F.expr("case when _label = 0 and rejects then 1 end")).alias("true_rejected")))
    counts = materialize(counts)
    strata = max(1, counts.select("stratum").distinct().count())
    limit, level = alpha / len(rule_set), delta / (strata * len(rule_set))

    def one(grid: pd.DataFrame) -> pd.DataFrame:
        best = []
        for r in grid.sort_values("step").itertuples():
            p = binomial_tail(int(r.false_rejected), int(r.n_good), limit)
            if p > level:
                break
            if r.true_rejected:
                best = [(r.stratum, r.rule, float(r.cutoff), int(r.n_good), int(r.false_rejected), p)]
        return pd.DataFrame(best, columns=["stratum", "rule", "cutoff", "n_good", "false_rejected", "p_value"])

    return counts.groupBy("stratum", "rule").applyInPandas(
        one, "stratum string, rule string, cutoff double, n_good long, false_rejected long, p_value double")


def apply_rules(stats: DataFrame, cutoffs: DataFrame, rule_set: dict | None = None,
                max_broadcast_strata: int = 10_000) -> DataFrame:
    """Add ``kept`` (false if the base rule or a certified cutoff rejects) and ``rejected_by``."""
    rule_set = rule_set or rules()
    wide = cutoffs.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"_cut_{name}") for name in rule_set])
    wide = broadcast_checked(wide, max_broadcast_strata)
    hits = F.filter(F.array(*[F.when(F.coalesce(stat > F.col(f"_cut_{name}"), F.lit(False)), F.lit(name))
                              for name, (stat, _) in rule_set.items()]), lambda x: x.isNotNull())
    return (stats.join(wide, "stratum", "left").withColumn("rejected_by", hits)
            .withColumn("kept", F.expr("not base_failed and size(rejected_by) = 0"))
            .drop(*[f"_cut_{name}" for name in rule_set]))


@query("op1_risk_rules")
def op1_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; strata are languages, the holdout all labelled rows."""
    stats = materialize(text_statistics(load(spark, sf_dir, "documents")))
    kept = apply_rules(stats, certify(stats, load(spark, sf_dir, "labels")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))
