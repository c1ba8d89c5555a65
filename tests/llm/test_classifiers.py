import numpy as np
import pytest
from helpers import clashing, frame, messy, prose, row

from arbiter.llm import factorization as M
from arbiter.llm import ordinal as O
from arbiter.llm.sparse import sigmoid


def test_sum_of_squares_identity():
    r = np.random.default_rng(0)
    bits = 4
    m = M.FactorizationMachine(0.3, r.normal(size=18), r.normal(size=(18, 3)), np.zeros(2), np.ones(2), bits)
    f, x, dense = np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0]), np.array([[0.4, -0.2], [0.0, 0.1]])
    got = m.raw(f, x, np.array([0, 3, 3]), dense)
    for k, (ff, xx) in enumerate(((f, x), (f[:0], x[:0]))):
        ff, xx = np.append(ff, [16, 17]), np.append(xx, dense[k])
        y = 0.3 + m.w[ff] @ xx + sum(m.v[ff[i]] @ m.v[ff[j]] * xx[i] * xx[j] for i in range(len(ff)) for j in range(i))
        assert got[k] == pytest.approx(y)


def quality_rows():
    good = [row(i, prose(i, 60)) for i in range(300)]
    bad = [row(1000 + i, prose(i, 60).upper().replace(" ", "!! ")) for i in range(100)]
    return good, bad


def auc(p, y):
    rank = np.argsort(np.argsort(p)) + 1
    n = y.sum()
    return (rank[y].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality_on_held_out_rows(spark):
    good, bad = quality_rows()
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(5, None), (None, 0), (77777, 1)], "doc_id long, quality int")
    docs = clashing(spark, good + bad)
    model = M.train(docs, labels, per_label=120)
    got = M.scores(docs, model).collect()
    held = [g for g in got if g.held_out]
    assert 40 < len(held) < 120 and len(got) == 400
    assert auc(np.array([g.score for g in held]), np.array([g.doc_id < 1000 for g in held])) > 0.97
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    kept = M.keep_predicted(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {g.doc_id for g in got if g.predicted}


def test_classifiers_on_odd_input(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(6, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    both = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    docs = clashing(spark, messy())
    for labels in (none, one, both):
        got = M.scores(docs, M.train(docs, labels)).collect()
        assert len(got) == len(messy()) and all(0 <= g.score <= 1 for g in got)
        got = O.severity(docs, O.train(docs, labels)).collect()
        assert len(got) == len(messy()) and all(0 <= g.p_severe <= g.p_toxic <= 1 for g in got)
    empty = frame(spark, [])
    assert M.scores(empty, M.train(empty, both)).count() == 0 and O.severity(empty, O.train(empty, both)).count() == 0
    assert M.keep_predicted(empty, M.train(docs, none)).count() == 0


def test_cumulative_link_orders_grades():
    r = np.random.default_rng(5)
    rows, grades = [], []
    for _ in range(900):
        g = int(r.integers(0, 3))
        rows.append(np.unique(np.concatenate([r.integers(10, 200, 20), np.arange(g * 2)])))  # graver rows hold more marked words
        grades.append(g)
    grades = np.array(grades)
    sample = {"feature": np.concatenate(rows), "offsets": np.concatenate([[0], np.cumsum([len(x) for x in rows])])}
    m = O.fit(sample, grades, prior=(grades > 0).mean(), bits=8)
    assert (np.diff(m.theta) > 0).all()
    p = m.exceed(sample["feature"], sample["offsets"])
    severity = p.sum(1)
    means = [severity[grades == g].mean() for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]
    # the likelihood's gradient vanishes for the thresholds: expected and seen shares agree
    assert np.abs(p.mean(0) - [(grades >= k).mean() for k in (1, 2)]).max() < 0.05
    assert sigmoid(np.array([0.0]))[0] == 0.5


def test_toxic_words_flagged_and_clean_rows_left_alone(spark):
    clean = [row(i, prose(i, 50)) for i in range(400)]
    toxic = [row(1000 + i, prose(i, 40) + " vile, " + prose(i + 1, 10) + " wretched." + " vile" * (i % 4)) for i in range(100)]
    labels = spark.createDataFrame([(r[0], 0) for r in clean[:200]] + [(r[0], 1) for r in toxic[:60]], "doc_id long, toxic int")
    docs = frame(spark, clean + toxic)
    got = {r.doc_id: r for r in O.severity(docs, O.train(docs, labels)).collect()}
    assert np.mean([got[r[0]].flagged for r in toxic[60:]]) > 0.9
    assert np.mean([got[r[0]].flagged for r in clean[200:]]) < 0.05
    assert np.mean([got[r[0]].severity for r in toxic]) > 10 * np.mean([got[r[0]].severity for r in clean])
