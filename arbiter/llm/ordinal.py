"""Toxicity: cumulative-link (proportional-odds) regression of severity grades on sparse text features.

    P(grade >= k | x) = sigmoid(w.x - theta_k),   theta_1 < theta_2 < ... ,   severity = sum_k P(grade >= k)

All thresholds share the weights w.  Inputs are presences of lower-cased words in ``2 ** bits`` hash buckets
that occur in at least ``min_rows`` sampled rows.  Grades come as labels; where a table has only 0 and 1
(``labels.toxic``), ``severity_grades`` derives three: 0 for label 0; of label 1, grade 2 for the rows with more
marked words a word than the median of them, else 1.  A word is marked if its smoothed log odds between
the labels is at least ``MARKED``.

The model is fitted in the driver on a bounded sample, at most ``per_label`` labelled rows of each label
(default 6,000), by AdaGrad on the exact likelihood with an L2 penalty; thresholds are then shifted to the
true share of label 1.  Every fifth row of the sample is left out of the fit and sets the probability from
which a row is flagged: the one with the largest true less five times the false share.  Scoring is one pass over whole texts with the model broadcast (2 ** bits floats).

Nulls and odd input: null and empty texts have no words, so the lowest severity; without labelled rows
of both kinds every row gets the labels' share (0 without any); repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm import words as W
from arbiter.llm.registry import query
from arbiter.llm.sparse import collect_features, labelled_sample, sigmoid, sums, word_features
from arbiter.llm.tables import by_slices, load, one_label

BITS, PER_LABEL, MARKED = 18, 6000, 2.0


@dataclass
class CumulativeLink:
    w: np.ndarray
    theta: np.ndarray
    bits: int = BITS
    flag: float = 0.5

    def exceed(self, feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= k) of every row, one column a threshold."""
        return sigmoid(sums(self.w[feature], offsets)[:, None] - self.theta)


def extract(batch: pa.RecordBatch, bits: int = BITS, text: int = 2):
    w = W.split(batch.column(text))
    data = w.data.copy()
    # words without the punctuation around them: "idiot," counts as "idiot"
    edge = np.frombuffer(bytes(1 if chr(b) in ".,;:!?\"'()[]{}" else 0 for b in range(256)), np.uint8).astype(bool)
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        starts = np.where((ends - starts > 1) & edge[data[np.minimum(starts, max(len(data) - 1, 0))]], starts + 1, starts) if len(starts) else starts
        ends = np.where((ends - starts > 1) & edge[data[ends - 1]], ends - 1, ends) if len(ends) else ends
    inside = W.Words(data, w.offsets, starts, ends, w.row, w.counts, w.first)
    gap = np.ones(len(data), bool)
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    gap = np.cumsum(edges[:-1]) == 0
    data[gap] = 0x20  # what was cut off counts as white space, which adds nothing to a hash
    row, feature, _ = word_features(inside, W.hashes(inside, lower=True), bits)
    return row, feature, np.ones(len(row)), np.zeros((batch.num_rows, 1))


def severity_grades(sample: dict, n_features: int) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0 and 1."""
    y, off, f = sample["label"], sample["offsets"], sample["feature"]
    rows = np.repeat(y, np.diff(off))
    a, b = (np.bincount(f[rows == k], minlength=n_features) for k in (1, 0))
    odds = np.log((a + 0.5) / (max((y == 1).sum(), 1) + 1)) - np.log((b + 0.5) / (max((y == 0).sum(), 1) + 1))
    marked = (odds >= MARKED) & (a >= 5)
    density = sums(marked[f].astype(float), off) / np.maximum(np.diff(off), 1)
    toxic = y == 1
    cut = np.median(density[toxic]) if toxic.any() else 0.0
    return np.where(toxic, 1 + (density > cut), 0)


def fit(sample: dict, grades: np.ndarray, prior: float, bits: int = BITS, min_rows: int = 5, epochs: int = 10,
        batch: int = 256, rate: float = 0.1, decay: float = 2e-3, seed: int = 7) -> CumulativeLink:
    """Maximise the likelihood of ``grades`` (0..K); ``prior`` is the true share of grades above 0."""
    n, off = 1 << bits, sample["offsets"]
    top = int(grades.max()) if len(grades) else 0
    p = min(max(prior, 1e-6), 1 - 1e-6)
    if top == 0 or grades.min() > 0:
        return CumulativeLink(np.zeros(n), np.array([-np.log(p / (1 - p)) if len(grades) else 30.0]), bits)
    rng = np.random.default_rng(seed)
    use = np.bincount(sample["feature"], minlength=n) >= min_rows
    w = np.zeros(n)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-2))  # theta_k = first + sums of exp(gaps): ordered
    gw, gt = np.full(n, 1e-2), np.full(top, 1e-2)
    for _ in range(max(epochs, 300 * batch // len(grades))):  # small samples get more passes
        for rows in np.array_split(rng.permutation(len(grades)), max(1, len(grades) // batch)):
            size = off[rows + 1] - off[rows]
            o = np.concatenate([[0], np.cumsum(size)])
            f = sample["feature"][np.arange(o[-1]) + np.repeat(off[rows] - o[:-1], size)]
            live = use[f]
            theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            eta = sums(np.where(live, w[f], 0.0), o)
            e = np.concatenate([np.ones((len(rows), 1)), sigmoid(eta[:, None] - theta), np.zeros((len(rows), 1))], 1)
            d = e * (1 - e)
            g = grades[rows]
            r = np.arange(len(rows))
            prob = np.maximum(e[r, g] - e[r, g + 1], 1e-9)
            d_eta = -(d[r, g] - d[r, g + 1]) / prob / len(rows)
            d_theta = np.zeros((len(rows), top + 2))
            d_theta[r, g] += d[r, g] / prob
            d_theta[r, g + 1] -= d[r, g + 1] / prob
            dt = d_theta[:, 1:-1].sum(0) / len(rows)
            u, back = np.unique(f[live], return_inverse=True)
            dw = np.bincount(back, weights=np.repeat(d_eta, size)[live], minlength=len(u)) + decay * w[u]
            gw[u] += dw ** 2
            w[u] -= rate * dw / np.sqrt(gw[u])
            tail = np.cumsum(dt[::-1])[::-1]  # a change of an early step moves all later thresholds
            step = np.concatenate([[tail[0]], tail[1:] * np.exp(gaps)])
            gt += step ** 2
            first -= rate * step[0] / np.sqrt(gt[0])
            gaps -= rate * step[1:] / np.sqrt(gt[1:])
    theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    seen = (grades > 0).mean()
    theta += np.log(seen / (1 - seen)) - np.log(p / (1 - p))
    return CumulativeLink(w, theta, bits)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> CumulativeLink:
    counts = one_label(labels, "toxic").agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    prior = counts[1] / counts[0] if counts[0] else 0.0
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = collect_features(labelled_sample(src, labels, "toxic", per_label), extract, [])
    grades = severity_grades(sample, 1 << BITS)
    rest = np.arange(len(grades)) % 5 == 4
    model = fit(_rows(sample, ~rest), grades[~rest], float(prior))
    held = _rows(sample, rest)
    p, y = model.exceed(held["feature"], held["offsets"])[:, 0], grades[rest] > 0
    if y.any() and not y.all():
        cuts = np.unique(p)
        gain = [(p[y] >= c).mean() - 5 * (p[~y] >= c).mean() for c in cuts]
        best = int(np.argmax(gain))
        below = p[p < cuts[best]]
        model.flag = float(np.sqrt(cuts[best] * below.max())) if len(below) else float(cuts[best])
    return model


def _rows(sample: dict, pick: np.ndarray) -> dict:
    size = np.diff(sample["offsets"])
    return {"offsets": np.concatenate([[0], np.cumsum(size[pick])]), "feature": sample["feature"][np.repeat(pick, size)]}


def severity(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """(doc_id, severity, p_toxic, p_severe, flagged) of every row; ``flagged``: P(grade >= 1) reaches the model's ``flag``."""
    bits = model.bits
    shipped = docs.sparkSession.sparkContext.broadcast(CumulativeLink(model.w.astype(np.float32), model.theta, bits, model.flag))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row, feature, _, _ = extract(b, bits, 1)
        p = shipped.value.exceed(feature, np.searchsorted(row, np.arange(b.num_rows + 1)))
        return pa.record_batch([b.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(p[:, 0] >= shipped.value.flag)],
                               names=["doc_id", "severity", "p_toxic", "p_severe", "flagged"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return by_slices(src, "text", run, "doc_id long, severity double, p_toxic double, p_severe double, flagged boolean")


@query("op7_ordinal_toxicity")
def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learned from a bounded sample of ``labels``."""
    docs = load(spark, sf_dir, "documents")
    return severity(docs, train(docs, load(spark, sf_dir, "labels")))
