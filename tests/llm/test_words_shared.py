import numpy as np
import pyarrow as pa
import pytest
from helpers import messy, words

from arbiter.llm import words as W
from arbiter.llm.components import components
from arbiter.llm.shared import ArrayStore, deltas, from_low, from_planes, low_planes, pack_sorted, planes, sum_by_key, undelta, unpack_sorted


def test_words_and_hashes_match_plain_split():
    texts = [r[1] for r in messy()]
    col = pa.array(["skip", *texts]).slice(1)
    w = W.split(col)
    got = [[] for _ in texts]
    for a, b, r in zip(w.starts, w.ends, w.row):
        got[r].append(w.data[a:b].tobytes())
    assert got == [words(t) for t in texts]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    for lower in (False, True):
        flat = [W.hash_one(x, lower) for t in texts for x in words(t)]
        assert W.hashes(w, lower).tolist() == flat
    assert W.hash_one(b"ABC", True) == W.hash_one(b"abc") != W.hash_one(b"ABC")


@pytest.mark.parametrize("k", [1, 2, 5])
def test_windows_and_shingles(k):
    texts = ["a b c d e f", "", None, "a b c d e f", "a b", "a b a b a b a b"]
    w = W.split(pa.array(texts))
    rows, hs = W.shingles(w, W.hashes(w), k)
    for i, t in enumerate(texts):
        ws = words(t)
        n = len({tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)}) if len(ws) >= k else int(bool(ws))
        assert (rows == i).sum() == n
    assert hs[rows == 0].tolist() == hs[rows == 3].tolist()


def test_slices_cover_all_rows():
    b = pa.record_batch([pa.array(["x" * n for n in (5, 0, 100, 3, 3)])], names=["text"])
    assert [s.num_rows for s in W.slices(b, "text", 10)] == [2, 1, 2]
    assert list(W.slices(b.slice(0, 0), "text")) == []


def test_packing_round_trips(tmp_path):
    r = np.random.default_rng(1)
    a = np.sort(r.integers(0, 2**63, 1000).astype(np.uint64))
    assert (unpack_sorted(pack_sorted(a)) == a).all()
    assert (from_planes(planes(a), np.uint64) == a).all()
    assert (from_low(low_planes(a)) == a & np.uint64(2**48 - 1)).all()
    assert (undelta(deltas(np.array([3, 3, 9]))) == [3, 3, 9]).all()
    k, c = sum_by_key(np.array([5, 1, 5], np.uint64), np.array([1, 2, 3]))
    assert k.tolist() == [1, 5] and c.tolist() == [2, 4]
    store = ArrayStore(f"file://{tmp_path}/m")
    store.save("x", a)
    store.save("x", a)  # a task that runs again
    assert isinstance(store.load("x"), np.memmap) and (store.load("x") == a).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (7, 3), (200, 201), (None, 5)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200, **{300 + i: 300 for i in range(51)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
