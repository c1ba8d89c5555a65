"""Divergence of sources against plain Python, and the perfect hashes alone."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, frame, messy, row

from arbiter.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=10, top=10):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]) for _, text, lang, source, *_ in rows]
    seen, out = {}, []
    for lang, _, ts in docs:
        for t in set(ts):
            seen[lang, t] = seen.get((lang, t), 0) + 1
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (x, t), n in seen.items() if x == lang and n >= min_docs)
        groups = {}
        for x, source, ts in docs:
            if x == lang:
                g = groups.setdefault(source, dict.fromkeys(kept, 0))
                for t in ts:
                    if t in g:
                        g[t] += 1
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}

        def share(g):
            total = sum(g.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c + 2) // total for t, c in g.items()}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: share(g) for s, g in groups.items()}, share(whole)
        for s in groups:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            named = [(far(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", named, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def run(spark, rows, **settings):
    df = frame(spark, rows).repartition(3) if rows else frame(spark, rows)
    return sorted(map(tuple, D.audit(df, **settings).collect()))


def corpus(n, seed=1, langs=("en", "de", None), sources=("a", "b", "c", "", None)):
    r = random.Random(seed)
    vocab = [r.choice(["w", "Ü", "İx", "Z"]) + "".join(r.choice("abcdé") for _ in range(r.randrange(1, 4))) for _ in range(90)]
    out = []
    for i in range(n):
        s = r.choice(sources)
        words = [r.choice(vocab[:30 + 15 * len(s or "")]) for _ in range(r.randrange(0, 25))]
        out.append(row(i, r.choice([" ", ", ", "7", "\n"]).join(words), r.choice(langs), s))
    return out


@pytest.mark.parametrize("settings", [{}, {"keys": 7, "wave_bytes": 300, "dense_bytes": 400, "block": 2}, {"min_docs": 1, "keys": 50, "top": 3}])
def test_plain_version(spark, settings):
    rows = corpus(300) + messy() + [row(900, "only here", "xx", "s1"), row(901, "", "xx", "s2")]
    want = plain(rows, settings.get("min_docs", 10), settings.get("top", 10))
    assert run(spark, rows, **settings) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [row(1, None), row(None, "")]) == []
    assert run(spark, [row(1, "a", "en", "x"), row(2, "b", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    rows = [row(i % 3, "Same same words " + "long" * 50 + " " + "x" * 100_000, "en", f"s{i % 4}") for i in range(48)] + [row(99, "same", "en", "s0")]
    assert run(spark, rows, block=1) == plain(rows)
    got = D.audit(clashing(spark, rows))
    assert sorted(map(tuple, got.collect())) == plain(rows) and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_one_source_with_most_rows(spark):
    rows = [row(i, f"alpha beta w{i % 5} gamma", "en", "hot" if i % 3 else f"s{i % 40}") for i in range(600)]
    assert run(spark, rows, dense_bytes=64, block=4) == plain(rows)


class Shard:
    def __init__(self, **x):
        self.__dict__.update(x)


def hashes_of(by_lang, shards=1):
    rows, terms = [], []
    for lang, words in by_lang.items():
        h = D.term_hashes(pa.array(words, pa.string()))
        for k in range(shards):
            mine = np.flatnonzero(D.shard_of(h, shards) == k)
            if len(mine):
                bits, sizes, slot = D.build_hash(h[mine])
                assert sorted(slot) == list(range(len(mine)))  # minimal and perfect
                col = pa.array([words[i] for i in mine[np.argsort(slot)]], pa.string())
                terms += col.to_pylist()
                rows.append(Shard(sid=len(rows), lang=lang, shard=k, shards=shards, n=len(mine), bits=bits.tobytes(), sizes=sizes.tobytes(), keys=D.stored_keys(col).to_pylist()))
    return D.PerfectHashes(rows), terms


@pytest.mark.parametrize("n,shards", [(1, 1), (2, 1), (500, 1), (5000, 7)])
def test_perfect_hashes(n, shards):
    words = [f"term{i}" + "y" * (i % 70) for i in range(n)]
    found, terms = hashes_of({"a": words, "b": words[::2]}, shards)
    ask = words + [w + "!" for w in words]
    for lang, has in (("a", set(words)), ("b", set(words[::2])), ("c", set())):
        slot = found.slots(lang, pa.array(ask, pa.large_string()))
        assert [terms[s] if s >= 0 else None for s in slot] == [w if w in has else None for w in ask]
        assert len({s for s in slot if s >= 0}) == len(has)


def test_terms_of_equal_hashes(monkeypatch):
    """Keys that no level separates, and strangers with the hash of a key, are told by the stored keys."""
    monkeypatch.setattr(D, "term_hashes", lambda col: np.array([len(x) for x in col.to_pylist()], np.uint64))
    words = ["aa", "bb", "cc", "d", "eeee"]
    found, terms = hashes_of({"l": words, "m": ["zz", "yyy"]})
    ask = ["bb", "xx", "d", "q", "cc", "ffff", "aa", "eeee", "zz"]
    slot = found.slots("l", pa.array(ask, pa.large_string()))
    assert [terms[s] if s >= 0 else None for s in slot] == ["bb", None, "d", None, "cc", None, "aa", "eeee", None]


def test_shares_are_exact():
    r = random.Random(4)
    total = [r.randrange(1, 9 * 10**15) for _ in range(500)] + [1, 3, 9 * 10**15]
    count = [r.randrange(0, t) for t in total]
    assert D.shares(np.array(count), np.array(total)).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(count, total)]
