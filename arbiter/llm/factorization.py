"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],   score = sigmoid(y)

so the pairwise interactions cost time linear in the features.  Inputs are a text's word counts in
``2 ** bits`` hash buckets (square roots, divided to unit length), standardised structure statistics, and
the metadata column ``n_chars`` where the table has one (labels, language, source and ids are never inputs).

The model is fitted in the driver by AdaGrad on a bounded sample: at most ``per_label`` labelled rows of each
label (default 6,000), the prior corrected for the sampling; texts of the sample are whole.  Scoring is
one pass over all documents with the model in the task closure (a fixed (2 ** bits) x (rank + 1) floats).

Nulls and odd input: null and empty texts have no words and get a score from their (zero) statistics;
a null ``n_chars`` counts as the length of the text; without labelled rows of both kinds the score is the
share of label 1 (0.5 without any); repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm import words as W
from arbiter.llm.registry import query
from arbiter.llm.risk_rules import structure
from arbiter.llm.sparse import collect_features, labelled_sample, sigmoid, sums, word_features
from arbiter.llm.tables import by_slices, fold, load, one_label

BITS, RANK, PER_LABEL, THRESHOLD = 16, 8, 6000, 0.3


@dataclass
class FactorizationMachine:
    """Weights: hash buckets first, dense features after them."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bits: int = BITS

    def raw(self, feature: np.ndarray, value: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.clip((dense - self.mean) / self.scale, -4, 4)
        n = 1 << self.bits
        vx = self.v[feature] * value[:, None].astype(self.v.dtype)
        s = sums(vx, offsets) + z @ self.v[n:]
        q = sums(vx * vx, offsets) + (z * z) @ (self.v[n:] ** 2)
        return self.bias + sums(self.w[feature] * value, offsets) + z @ self.w[n:] + 0.5 * (s * s - q).sum(1)


def extract(batch: pa.RecordBatch, bits: int = BITS, text: int = 2, n_chars: int = 3):
    """(row, feature, value, dense) of a slice."""
    w = W.split(batch.column(text))
    h = W.hashes(w, lower=True)
    row, feature, count = word_features(w, h, bits)
    value = np.sqrt(count / np.maximum(w.counts[row], 1))
    s = {k: v.astype(float) for k, v in structure(w, h).items()}
    words, chars, letters = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_letters"], 1)
    given = batch.column(n_chars).to_numpy(zero_copy_only=False).astype(float)
    distinct = np.bincount(row, minlength=batch.num_rows)[:batch.num_rows]
    length = s["word_chars"] + s["n_words"]
    dense = np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words, s["n_upper"] / letters, s["n_marks"] / words, s["n_letters"] / chars, distinct / words,
        s["n_lines"] / words, np.log1p(np.maximum(np.where(np.isnan(given), length, given), 0))], 1)
    return row, feature, value, dense


def fit(sample: dict, prior: float, bits: int = BITS, rank: int = RANK, epochs: int = 8, batch: int = 128,
        rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the logistic loss; ``prior`` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    y, off, dense = sample["label"].astype(float), sample["offsets"], sample["dense"]
    n = 1 << bits
    k = dense.shape[1]
    if len(y) == 0 or y.min() == y.max():
        k = k or 11
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return FactorizationMachine(float(np.log(p / (1 - p))), np.zeros(n + k), np.zeros((n + k, rank)), np.zeros(k), np.ones(k), bits)
    mean, scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    m = FactorizationMachine(0.0, np.zeros(n + k), rng.normal(0, 0.02, (n + k, rank)), mean, scale, bits)
    gw, gv, gb = np.full(n + k, 1e-2), np.full((n + k, rank), 1e-2), 1e-2
    z_all = np.clip((dense - mean) / scale, -4, 4)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(max(epochs, 100 * batch // len(y))):  # small samples get more passes
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            size = off[rows + 1] - off[rows]
            o = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(o[-1]) + np.repeat(off[rows] - o[:-1], size)
            f, x, z = sample["feature"][take], sample["value"][take], z_all[rows]
            vx = m.v[f] * x[:, None]
            s = sums(vx, o) + z @ m.v[n:]
            q = sums(vx * vx, o) + (z * z) @ (m.v[n:] ** 2)
            raw = m.bias + sums(m.w[f] * x, o) + z @ m.w[n:] + 0.5 * (s * s - q).sum(1)
            g = (sigmoid(raw) - y[rows]) * weight[rows] / len(rows)
            gr = np.repeat(g, size)
            u, back = np.unique(f, return_inverse=True)
            dw = np.bincount(back, weights=gr * x, minlength=len(u)) + decay * m.w[u]
            each = (gr * x)[:, None] * (np.repeat(s, size, axis=0) - vx)
            dv = np.stack([np.bincount(back, weights=each[:, j], minlength=len(u)) for j in range(rank)], 1) + decay * m.v[u]
            zw = z.T @ g + decay * m.w[n:]
            zv = z.T @ (g[:, None] * s) - ((z * z).T @ g)[:, None] * m.v[n:] + decay * m.v[n:]
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(gb)
            gw[u] += dw ** 2
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            gv[u] += dv ** 2
            m.v[u] -= rate * dv / np.sqrt(gv[u])
            gw[n:] += zw ** 2
            m.w[n:] -= rate * zw / np.sqrt(gw[n:])
            gv[n:] += zv ** 2
            m.v[n:] -= rate * zv / np.sqrt(gv[n:])
    p = min(max(prior, 1e-3), 1 - 1e-3)
    m.bias += float(np.log(p / (1 - p)))  # the weighted sample is balanced
    return m


def with_inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> FactorizationMachine:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.where(fold("doc_id", 5) != 0)
    counts = one_label(known, "quality").agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    prior = counts[1] / counts[0] if counts[0] else 0.5
    sample = labelled_sample(with_inputs(docs), known, "quality", per_label)
    return fit(collect_features(sample, extract, ["n_chars"]), float(prior))


def scores(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    schema = "doc_id long, held_out boolean, score double, predicted int"
    small = FactorizationMachine(model.bias, model.w.astype(np.float32), model.v.astype(np.float32), model.mean, model.scale, model.bits)
    shipped = docs.sparkSession.sparkContext.broadcast(small)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row, feature, value, dense = extract(b, small_bits)
        p = sigmoid(shipped.value.raw(feature, value, np.searchsorted(row, np.arange(b.num_rows + 1)), dense))
        return pa.record_batch([b.column(0), b.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                               names=["doc_id", "held_out", "score", "predicted"])

    small_bits = small.bits
    src = with_inputs(docs).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text", "n_chars")
    return by_slices(src, "text", run, schema)


def keep_predicted(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns (one pass, no join)."""
    bits = model.bits
    shipped = docs.sparkSession.sparkContext.broadcast(
        FactorizationMachine(model.bias, model.w.astype(np.float32), model.v.astype(np.float32), model.mean, model.scale, bits))
    names = docs.columns
    text = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        count = b.column(chars) if chars is not None else pa.nulls(b.num_rows)
        view = pa.record_batch([b.column(text), count.cast(pa.float64())], names=["t", "c"])
        row, feature, value, dense = extract(view, bits, 0, 1)
        p = sigmoid(shipped.value.raw(feature, value, np.searchsorted(row, np.arange(b.num_rows + 1)), dense))
        return b.filter(pa.array(p >= threshold))

    return by_slices(docs, "text", run, docs.schema)


@query("op4_factorization_machine")
def op4_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learned from a bounded sample of ``labels``."""
    docs = load(spark, sf_dir, "documents")
    return scores(docs, train(docs, load(spark, sf_dir, "labels")))
