"""Hashed word counts of documents, and bounded labelled samples for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm import words as W
from arbiter.llm.tables import by_slices, one_label


def word_features(w: W.Words, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count): word counts of every row in ``2 ** bits`` hash buckets, sorted by row."""
    key = (w.row.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits))
    u, n = np.unique(key, return_counts=True)
    return (u >> np.uint64(bits)).astype(np.int64), (u & np.uint64((1 << bits) - 1)).astype(np.int64), n


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, per_label: int) -> DataFrame:
    """At most ``per_label`` labelled rows of each label (0 and 1), by the order of a hash of the id, with text.

    The sample of ids is bounded, so it is broadcast; the order is the same on every run.
    """
    one = one_label(labels, value)
    parts = [one.where(F.col("_label") == k).orderBy(F.xxhash64("_key"), "_key").limit(per_label) for k in (0, 1)]
    return docs.join(F.broadcast(parts[0].unionByName(parts[1])), F.col("doc_id") == F.col("_key")).drop("_key")


def collect_features(docs: DataFrame, extract, columns: list[str]) -> dict:
    """Features of a bounded sample in the driver: CSR arrays and dense columns, in the order of the rows' ids.

    ``extract(batch)`` gives (row, feature, value, dense matrix) of a slice whose first columns are
    doc_id, _label and text.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row, feature, value, dense = extract(b)
        cut = np.searchsorted(row, np.arange(b.num_rows + 1))
        lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(a, kind))
        return pa.record_batch([b.column(0), b.column(1).cast(pa.int32()), lists(feature, pa.int32()), lists(value, pa.float32()),
                                pa.FixedSizeListArray.from_arrays(pa.array(dense.ravel(), pa.float64()), dense.shape[1]).cast(pa.list_(pa.float64()))],
                               names=["doc_id", "label", "feature", "value", "dense"])

    got = by_slices(docs.select("doc_id", "_label", "text", *columns), "text", run,
                    "doc_id long, label int, feature array<int>, value array<float>, dense array<double>").toArrow().combine_chunks()
    order = np.lexsort([got["label"].to_numpy(), got["doc_id"].to_numpy()])
    got = got.take(pa.array(order)).combine_chunks()
    flat = lambda c: got[c].chunk(0) if got[c].num_chunks else got[c].combine_chunks()
    if got.num_rows == 0:
        return {"label": np.zeros(0, int), "offsets": np.zeros(1, np.int64), "feature": np.zeros(0, np.int64), "value": np.zeros(0), "dense": np.zeros((0, 0))}
    f = flat("feature")
    offsets = f.offsets.to_numpy().astype(np.int64)
    return {"label": got["label"].to_numpy(), "offsets": offsets - offsets[0], "feature": f.flatten().to_numpy().astype(np.int64),
            "value": flat("value").flatten().to_numpy().astype(np.float64),
            "dense": np.stack(got["dense"].to_pylist()).astype(np.float64)}


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the rows that ``offsets`` bound (empty rows: 0); values may have columns."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
