import random

import numpy as np
import pytest
from helpers import LOWER, clashing, frame, messy, row, wide_prose, words

from arbiter.llm import jaccard_join as J


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """All pairs of all rows."""
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(str((r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"e{seed}x{k}"
    return " ".join(w)


def corpus():
    rows = messy() + [row(100 + i, wide_prose(i, 60)) for i in range(30)]
    base = wide_prose(500, 150)
    rows += [row(200 + i, edited(base, i, i % 6)) for i in range(60)]  # a group of near copies
    rows += [row(300 + i, base) for i in range(80)]  # and of exact ones, above HOT
    line = wide_prose(600, 30)  # a line that most rows hold
    rows += [row(400 + i, line + "\n" + wide_prose(700 + i, 30 + i % 5)) for i in range(90)]
    rows += [row(600 + i, line + " " + wide_prose(800 + i, i % 9)) for i in range(80)]  # almost nothing else
    chain = wide_prose(900, 100).split()
    rows += [row(1000 - i, " ".join(chain[:40] + [f"c{j}" for j in range(i)] + chain[40 + i:])) for i in range(0, 20, 2)]
    return rows + [row(2000, "five words are just enough"), row(2001, "FIVE words are just enough"), row(2002, "three words here")]


def result(df):
    return sorted(str((g.doc_id, g.n_shingles, g.component_id)) for g in df.collect())


@pytest.mark.parametrize("parts,flush,part", [(1, 4_000_000, 2000), (5, 1500, 2000), (3, 4000, 25)])
def test_components_match_all_pairs(spark, monkeypatch, parts, flush, part):
    """In one flush, in many small ones, and with blocks cut into parts."""
    monkeypatch.setattr(J, "FLUSH", flush)
    monkeypatch.setattr(J, "PART", part)
    rows = corpus()
    assert result(J.near_duplicate_components(clashing(spark, rows).repartition(parts))) == plain(rows)


def test_borders(spark):
    """Exactly 75 percent links, a little less doesn't: sets of single shingles are sequences."""
    w = wide_prose(1, 200).split()
    rows = []
    for k, (common, own) in enumerate([(36, 6), (36, 7), (70, 12), (71, 12)]):
        a, b = w[:common + 4] + [f"a{k}_{j}" for j in range(own)], w[:common + 4] + [f"b{k}_{j}" for j in range(own)]
        rows += [row(10 * k, f"z{k} " * 0 + " ".join(f"{x}_{k}" if x[0] == "w" else x for x in a)),
                 row(10 * k + 1, " ".join(f"{x}_{k}" if x[0] == "w" else x for x in b))]
    got = result(J.near_duplicate_components(frame(spark, rows)))
    assert got == plain(rows) and len({g.rsplit(",")[-1] for g in got}) not in (1, len(rows))


def test_forest_of_a_cell_spans_its_links():
    r = np.random.default_rng(3)
    base = r.integers(0, 10**9, 80)
    sets, n = [], []
    for i in range(60):
        s = np.unique(np.concatenate([r.permutation(base)[:70 + i % 10], r.integers(10**9, 10**10, i % 8)]))
        sets.append(s)
        n.append(len(s))
    n = np.array(n)
    plen = n - -(-75 * n // 100) + 1
    out = J.join_cell(np.arange(60), n, plen, sets, np.zeros(60, int), np.zeros(60, bool))
    assert len(out) <= 59
    for a, b in out:
        k = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * k >= 75 * (n[a] + n[b] - k)


def test_drop_keeps_one_of_each_group(spark):
    rows = corpus()
    src = clashing(spark, rows)
    got = J.drop_near_duplicates(src)
    assert got.schema.simpleString() == src.schema.simpleString()
    ids = [g.doc_id for g in got.collect()]
    want = {eval(s)[0] for s in plain(rows) if eval(s)[0] == eval(s)[2] and eval(s)[0] is not None}
    assert set(ids) - {None} == want and ids.count(None) == 1 and ids.count(5) == 1


def test_empty(spark):
    assert J.near_duplicate_components(frame(spark, [])).count() == 0
    only = frame(spark, [row(1, None), row(2, ""), row(None, None)])
    assert result(J.near_duplicate_components(only)) == ["(1, 0, 1)", "(2, 0, 2)", "(None, 0, None)"]
