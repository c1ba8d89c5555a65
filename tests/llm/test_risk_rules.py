from math import comb

import pytest
from helpers import clashing, frame, messy, prose, row, words

from arbiter.llm import risk_rules as R


def plain(text):
    t = text or ""
    ws = words(t)
    wins = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    rep = {i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)} if len(wins) < 500 else set()
    lines = [x for x in t.split("\n") if x.encode().strip()]
    return (len(ws), sum(len(x.decode()) for x in ws), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))


def test_statistics_match_plain_python(spark):
    rows = messy() + [row(20, "a b c d e f a b c d e\nx\nx\n \nx"), row(21, "# * $ | <é> | %")]
    got = sorted(R.text_statistics(clashing(spark, rows)).collect(), key=str)
    want = sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    assert sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got), key=str) == want
    assert all(g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words) for g in got)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.05), (10, 10, 0.3), (0, 0, 0.5)])
def test_binomial_tail(k, n, p):
    assert R.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)))


def test_cutoffs_are_certified_per_stratum(spark):
    good = [row(i, prose(i, 40), "en") for i in range(400)]
    bad = [row(1000 + i, prose(i, 40).upper() + " ###", "en") for i in range(40)]
    few = [row(2000 + i, prose(i, 40).upper(), "fr") for i in range(30)]
    docs = frame(spark, good + bad + few)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad + few] + [(0, None), (None, 1), (99999, 0)], "doc_id long, quality int")
    stats = R.text_statistics(docs)
    cut = R.certify(stats, labels, alpha=0.12)
    by = {(r.stratum, r.rule): r for r in cut.collect()}
    assert ("en", "upper") in by and not any(s == "fr" for s, _ in by)  # no good rows certify nothing
    for r in by.values():
        assert R.binomial_tail(r.false_rejected, r.n_good, 0.12 / 6) <= 0.05 / (2 * 6)
    kept = {r.doc_id: r.kept for r in R.apply_rules(stats, cut).collect()}
    assert not any(kept[r[0]] for r in bad) and all(kept[r[0]] for r in few)
    assert sum(kept[r[0]] for r in good) >= 390


def test_empty_labels_and_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = frame(spark, messy())
    got = R.apply_rules(R.text_statistics(docs), R.certify(R.text_statistics(docs), none)).collect()
    assert len(got) == len(messy()) and all(g.kept == (not g.base_failed) for g in got)
    empty = frame(spark, [])
    assert R.apply_rules(R.text_statistics(empty), R.certify(R.text_statistics(empty), none)).count() == 0
