"""Codes of vectors against a plain version with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from arbiter.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, note string"


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) of kept rows and the codebooks, one comparison at a time."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    size = width // parts
    cut = [[(v + [0] * (width - len(v)))[k * size:(k + 1) * size] for k in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[list(cut[r][k]) for r in order] for k in range(parts)]

    def best(k, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[k]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for k in range(parts):
            got = [best(k, c[k])[0] for c in cut]
            moved = [[c[k] for c, g in zip(cut, got) if g == e] for e in range(len(books[k]))]
            books[k] = [[sum(col) // len(m) for col in zip(*m)] if m else books[k][e] for e, m in enumerate(moved)]
    out = []
    for (i, _, lab), c in zip(kept, cut):
        found = [best(k, c[k]) for k in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), lab))
    totals = {}
    for r in out:
        totals[r[3]] = totals.get(r[3], 0) + r[2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, totals[lab]) for i, c, e, lab in out], sha


def run(spark, rows, max_labels=V.MAX_LABELS):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    books = V.train(df)
    got = V.with_label_error(V.encode(df, books), max_labels)
    return sorted(map(repr, [(r.vec_id, r.code, r.error, r.label_error) for r in got.collect()])), books


def vectors(n, dim, seed=1, grid=8):
    r = random.Random(seed)
    return [(i, [r.randrange(-grid, grid) / 16 + 0.001 for _ in range(dim)], r.choice([0, 1, 1, 1, None])) for i in range(n)]


@pytest.mark.parametrize("dim,n", [(64, 150), (16, 200), (32, 20)])
def test_plain_version(spark, dim, n):
    rows = vectors(n, dim)
    rows = [(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in rows]
    want, sha = plain(rows)
    got, books = run(spark, rows)
    assert got == sorted(map(repr, want)) and books.sha256() == sha


def test_odd_rows(spark):
    f = float
    rows = vectors(70, 32, 3, 2) + [
        (500, None, 1), (501, [0.5] * 31 + [f("nan")], 1), (502, [f("inf")] * 32, 1), (503, [None] + [0.25] * 31, 0),
        (None, [0.125] * 32, None), (5, [0.75] * 32, 2), (5, [-0.75] * 32, 2), (5, [0.75] * 32, 2), (504, [0.5, -0.001], 9), (505, [], 9)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    want, sha = plain(rows)
    for limit in (V.MAX_LABELS, 1):  # labels by broadcast, and by the salted join
        got, books = run(spark, rows, limit)
        assert got == sorted(map(repr, want)) and books.sha256() == sha
    assert len(want) == 76


def test_empty_tables_and_large_components(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")] * 16, 1)]):
        got, books = run(spark, rows)
        assert got == [] and books.entries.size == 0
    got, _ = run(spark, [(1, [], 1), (2, [], 1)])
    assert got == [repr((i, "00" * 16, 0, 0)) for i in (1, 2)]
    with pytest.raises(Exception, match="would not fit"):
        run(spark, [(1, [1e9] * 16, 1)])


@pytest.mark.parametrize("leaves", [1, 3, 7, 4096])
def test_trie_equals_all_distances(monkeypatch, leaves):
    """Whatever part of a path is carried from one run of leaves to the next."""
    monkeypatch.setattr(V, "LEAVES", leaves)
    rng = np.random.default_rng(leaves)
    for depth in (1, 2, 4, 7):
        parts, where, copies = V.distinct_parts(rng.integers(-3, 3, (400, depth)))
        assert copies.sum() == 400 and (np.diff([tuple(p) for p in parts], axis=0) != 0).any(1).all()
        entries = rng.integers(-3, 3, (9, depth))  # equal entries: the lowest wins
        code, distance = V.nearest(parts, entries)
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_decoding_is_near(spark):
    rows = [(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in vectors(300, 32, 5)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    books = V.train(df)
    got = {r.vec_id: (r.code, r.error) for r in V.encode(df, books).collect()}
    codes = np.array([[int(got[i][0][2 * k:2 * k + 2], 16) for k in range(16)] for i, _, _ in rows])
    off = ((books.decode(codes) - np.array([v for _, v, _ in rows])) ** 2).sum(1)
    error = np.array([got[i][1] for i, _, _ in rows]) / 256 ** 2
    assert np.abs(np.sqrt(off) - np.sqrt(error)).max() < np.sqrt(32) / 256
