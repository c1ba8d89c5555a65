import itertools
import math
import random
import re
from collections import Counter

from helpers import clashing, frame, messy, prose, row

from arbiter.llm import credentials as C


def naive(text):
    out = []
    for kind, pat, ok in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
                          ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(pat, text, re.A) if ok(m)]
    return sorted(out)


def secret(r, n=40):
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def rows():
    r = random.Random(5)
    labelled = [row(1000 + i, prose(i, 20) + f" token = \"{secret(r)}\" " + prose(i + 1, 10)) for i in range(60)]
    return messy() + labelled + [
        row(100, "Password:short PASSWD='abcdefgh' api_key=  x api-key=abcdefghij apikey : 12345678"),
        row(101, "token=secret=abcdefgh12 then password=token : abcdefghijklm"), row(102, "é AKIAABCDEFGHIJKL AKIA1 xAKIA" + "Z" * 20 + "9"),
        row(103, "日本 " + secret(r, 32) + " " + secret(r, 31) + "g" + "a" * 40), row(104, "key " + secret(r, 28) + ", end"),
        row(105, "paſſword=abcdefghij toKen=abcdefghij"), row(106, "hyperbolicparaboloidsurfaces and www.example.com/very/long/path/of/words"),
        row(107, prose(3, 30) + " " + secret(r, 40) + "\n" + "AKIA" + "Q" * 16)]


def test_base_spans_match_the_patterns(spark):
    src = rows()
    got = C.scan(clashing(spark, src), {}).collect()
    want = []
    for x in src:
        s = naive(x[1] or "")
        want.append(str((x[0], *(sum(k == j for _, k, _ in s) for j in range(3)), ",".join(f"{C.KINDS[k]}:{a}:{b}" for a, k, b in s))))
    assert sorted(str((g.doc_id, g.n_assign, g.n_access, g.n_hex, g.base)) for g in got) == sorted(want)
    assert all(g.spans == g.base for g in got)  # no automata, no further spans


def test_automata_accept_the_format_and_not_prose(spark):
    r = random.Random(6)
    automata = C.learn(frame(spark, rows()))
    assert 0 in automata and sum(len(m.next) for m in automata[0].parts.values()) < 2000
    assert sum(automata[0].accepts(secret(r)) for _ in range(50)) >= 45
    assert not any(automata[0].accepts(x) for x in ("hyperbolic2paraboloid", "www.example.com/path/2/words", "2024-01-01T00:00:00.000Z"))
    found = {g.doc_id: g for g in C.scan(frame(spark, rows()), automata).collect()}
    assert set(filter(None, found[107].base.split(","))) <= set(found[107].spans.split(","))
    assert found[106].spans == ""


def test_merging_keeps_the_probabilities():
    r = random.Random(7)
    words = []
    for _ in range(600):  # (ab)+9 of geometric length: one loop
        n = 1
        while r.random() < 0.75:
            n += 1
        words.append("ab" * n + "9")
    a = C.infer(words)
    assert len(a.next) < 12  # a loop, not the tree
    for s in range(len(a.next)):
        assert a.total(s) == a.ends[s] + sum(a.count[s].values()) and a.count[s].keys() == a.next[s].keys()
    assert a.accepts("ababababab9") and not a.accepts("a9a9a9a9a9")
    assert a.mean_log("ababab9") > a.mean_log("99999zz")


def plain_compatible(a, s, t, alpha=C.ALPHA):
    """The Hoeffding test of two disjoint subtrees, recursively."""
    n, m = a.total(s), a.total(t)
    bound = (0.5 * math.log(2 / alpha)) ** 0.5 * (n ** -0.5 + m ** -0.5)
    pairs = [(a.ends[s], a.ends[t])] + [(a.count[s].get(x, 0), a.count[t].get(x, 0)) for x in {*a.count[s], *a.count[t]}]
    return all(abs(f / n - g / m) <= bound for f, g in pairs) and all(
        plain_compatible(a, a.next[s][x], a.next[t][x], alpha) for x in a.next[s] if x in a.next[t])


def test_compatibility_matches_the_recursive_form():
    r, seen = random.Random(11), set()
    for _ in range(20):
        words = ["".join(r.choice("aag9") for _ in range(r.choice([3, 3, 4, 7]))) for _ in range(r.choice([10, 80, 400]))]
        tree = C.Automaton()
        for w in words:
            tree.add([C.CLASS_OF[c] for c in w])
        n = len(tree.next)
        for s in range(1, min(n, 12)):
            for t in range(s + 1, min(n, 30)):
                want = plain_compatible(tree, s, t)
                seen.add(want)
                assert C.compatible(tree, s, t, C.ALPHA) == want
    assert seen == {True, False}


def test_automata_are_distributions_and_learn_lengths():
    """Probabilities of all strings sum to one; two lengths need more than one state, no other length is accepted."""
    words = ["".join(p) for n in (2, 4) for p in itertools.product("ab", repeat=n)] * 20
    a = C.infer(words, of={"a": "x", "b": "x"})
    total = sum(math.exp(a.log("".join(p))) for n in range(7) for p in itertools.product("ab", repeat=n) if a.log("".join(p)) > -8)
    assert len(a.next) == 5 and abs(total - 1) < 0.01
    assert [a.accepts("a" * n) for n in range(1, 7)] == [False, True, False, True, False, False]


def jwt(r):
    part = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    return f"eyJ{part(33)}.{part(140)}.{part(46)}"


def test_formats_outside_the_patterns(spark):
    """Mixed lengths, names before '=', short values, values beyond 128 characters, a rare format beside a frequent one."""
    r = random.Random(12)
    lower = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    src = [row(i, f"{prose(i, 30)} token={secret(r, 24 if i % 2 else 40)} {prose(i + 1, 9)}") for i in range(1200)]
    src += [row(2000 + i, f"password: {lower(12)} and") for i in range(300)] + [row(3000 + i, f"{prose(i, 9)} secret={jwt(r)}") for i in range(20)]
    g = C.learn(clashing(spark, src))
    assert len(g[0].parts["hex"].next) == 41 and {"hex", "lower", "alphanumeric"} <= set(g[0].parts)
    hit = lambda t: [t[a:b] for a, b, k in C.all_spans(t, g)[1] if k == 3]
    found = Counter()
    for _ in range(50):
        v, j = secret(r, 22) + "a7", jwt(r)
        assert hit(f"x auth={v} y") == hit(f"AWS_SECRET_ACCESS_KEY={v}.") == hit(f"id:{v}") == hit(f"key {v}, then")
        found["hex"] += hit(f"id:{v}") == [v]
        found["jwt"] += hit(f"bearer {j}, then") == [j]
        assert not hit(f"{secret(r, 21)}0a") and not hit(secret(r, 24) + "/" + secret(r, 9))
    assert found["hex"] >= 45 and found["jwt"] >= 40
    short = [lower(11) + "7" for _ in range(200)]
    assert sum(hit(f"see {u} here") == [u] for u in short if C.alphabet_of(u) == "lower" and any(map(str.isalpha, u))) >= 180
    plain = ["version2alpha", "2024-01-01T00:00:00.000Z", "www.example.com/path/2/words", "chapter12of30", "international2", "covid19update", "item_1200_of_9"]
    assert not any(hit(f"the {x} is") for x in plain)


def test_redaction(spark):
    src = clashing(spark, rows())
    automata = C.learn(src)
    got = C.redact(src, automata)
    assert got.schema == src.schema
    by = {}
    for g in got.collect():
        by.setdefault(g.doc_id, []).append(g)
    for x in rows():
        spans = C.all_spans(x[1] or "", automata)[1]
        texts = [g.text for g in by[x[0]]]
        if not spans:
            assert x[1] in texts
        else:
            out = texts[0]
            assert "[SECRET]" in out and not naive(out)
            assert by[x[0]][0].n_chars == len(out)


def test_empty(spark):
    none = frame(spark, [])
    assert C.learn(none) == {} and C.scan(none, {}).count() == 0 and C.redact(none, {}).count() == 0
