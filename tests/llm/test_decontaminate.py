import re

import pytest
from helpers import LOWER, clashing, frame, messy, prose, row, wide_prose

from arbiter.llm import decontaminate as D

BENCH = "item_id long, text string"


def cut(text):
    return re.findall("[0-9a-z\u0080-\U0010FFFF]+", (text or "").translate(LOWER))


def plain(rows, items, n=10):
    wins = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[k:k + n]), set()).update([] if i is None else [str(i)])
    out = []
    for r in rows:
        w, hit, ids = cut(r[1]), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k:k + size])) in wins:
                    hit |= set(range(k, k + size))
                    ids |= wins[x]
        out.append((r[0], len(w), len(hit), sorted(ids)))
    return sorted(map(str, out))


ITEMS = [(1, wide_prose(1, 30)), (2, wide_prose(2, 10)), (12, "Short Item, été"), (3, None), (4, " .. "), (5, wide_prose(1, 30)), (6, "x'y \"z"),
         (None, wide_prose(8, 12)), (1, wide_prose(9, 11)), (7, "ΑΣ ΤΗΣ"), (8, "solo")]


def docs():
    a = wide_prose(1, 30).split()
    return messy() + [row(20, prose(1, 20) + " " + wide_prose(1, 30).upper() + " tail"), row(21, "--".join(a[:9])), row(22, "--".join(a[:10])),
                      row(23, "a SHORT  item ÉTÉ b"), row(24, "a short item été b"), row(25, wide_prose(2, 10) + " . " + " ".join(a[3:25])),
                      row(26, "X!y?Z"), row(27, "ασ της ας ΤΗΣ ΑΣ ΤΗΣ"), row(28, "Solo solo SOLO"), row(28, wide_prose(8, 12)), row(29, wide_prose(2, 10) * 2)]


@pytest.mark.parametrize("max_set", [50_000, 3])
def test_hits_match_plain_python(spark, max_set):
    """Both the literal set and, beyond its bound, the shuffled join."""
    got = D.contamination(clashing(spark, docs()), frame(spark, ITEMS, BENCH), max_set=max_set).collect()
    assert sorted(str((g.doc_id, g.n_words, g.n_hit, [x for x in g["items"]])) for g in got) == \
        plain(docs(), ITEMS)


@pytest.mark.parametrize("max_set", [50_000, 3])
def test_removal_keeps_clean_documents_whole(spark, max_set):
    src = clashing(spark, docs())
    got = D.remove_contaminated(src, frame(spark, ITEMS, BENCH), max_set=max_set)
    assert got.schema.simpleString() == src.schema.simpleString()
    clean = [eval(s) for s in plain(docs(), ITEMS)]
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(c[0]) for c in clean if not c[2])


def test_empty_tables(spark):
    none = frame(spark, [], BENCH)
    assert {g.n_hit for g in D.contamination(frame(spark, messy()), none).collect()} == {0}
    assert D.contamination(frame(spark, []), frame(spark, ITEMS, BENCH)).count() == 0
    assert D.remove_contaminated(frame(spark, messy()), none).count() == len(messy())


def test_no_python_on_executors(spark):
    plan = D.contamination(frame(spark, messy()), frame(spark, ITEMS, BENCH))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    plan = D.remove_contaminated(frame(spark, messy()), frame(spark, ITEMS, BENCH))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
