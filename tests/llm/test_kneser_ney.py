import math
from collections import Counter, defaultdict

import pytest
from helpers import LOWER, clashing, frame, messy, prose, row, words
from pyspark.sql import functions as F

from arbiter.llm import kneser_ney as K


def tokens(text):
    return [w.decode() for w in words((text or "").translate(LOWER))] + ["</s>"]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        toks = [tokens(t) for t in texts]
        self.c = Counter(x for t in toks for x in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.bi = Counter(b for t in toks for b in zip(["<s>", *t], t))
        self.ctx = defaultdict(Counter)
        self.con = Counter()
        for (a, b), k in self.bi.items():
            self.ctx[a][b] = k
            self.con[b] += 1
        coc = lambda xs: [sum(1 for x in xs if x == k) for k in (1, 2, 3, 4)]
        self.d, self.cd = K._discounts(coc(self.bi.values())), K._discounts(coc(self.con.values()))

    def less(self, c, d):
        return max(c - d[min(c, 3) - 1], 0) if c else 0

    def lower(self, w):
        total = sum(self.con.values())
        back = sum(self.cd[min(k, 3) - 1] for k in self.con.values()) / total
        return self.less(self.con[w], self.cd) / total + back / (self.v + 1)

    def p(self, a, w):
        ctx = self.ctx.get(a)
        if not ctx:
            return self.lower(w)
        total = sum(ctx.values())
        return self.less(ctx.get(w, 0), self.d) / total + sum(self.d[min(k, 3) - 1] for k in ctx.values()) / total * self.lower(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(a, w)) for a, w in zip(["<s>", *t], t))

    def base(self, text):
        return sum(math.log10((self.c[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in tokens(text))


def scored(spark, train, test):
    model = K.train(frame(spark, train).repartition(3))
    return model, {(r.doc_id, r.n_tokens): r for r in K.score(frame(spark, test).withColumn("held_out", F.lit(True)), model).collect()}


def test_scores_match_dictionaries(spark):
    train = [row(i, prose(i, 60 + i)) for i in range(30)] + messy() + [row(50, "the " * 400)]
    test = [row(100, prose(77, 50)), row(101, "unseen words alpha beta"), row(102, None), row(103, "ALPHA beta"), row(104, "the the the")]
    plain = Plain([r[1] for r in train])
    model, got = scored(spark, train, test)
    assert (model.tokens, model.vocabulary, model.distinct_bigrams) == (plain.n, plain.v, len(plain.bi))
    for r in test:
        g = got[r[0], len(tokens(r[1]))]
        assert g.score == pytest.approx(plain.score(r[1]), rel=1e-9)
        assert g.base_score == pytest.approx(plain.base(r[1]), rel=1e-9)
        assert g.n_known == sum(plain.c[x] > 0 for x in tokens(r[1])) and g.train_tokens == plain.n
        assert g.perplexity == pytest.approx(10 ** (-g.score / g.n_tokens))


def test_probabilities_sum_to_one():
    plain = Plain([prose(i, 50) for i in range(20)])
    for ctx in ("<s>", "alpha", "beta,", "never seen"):
        assert sum(plain.p(ctx, w) for w in plain.c) + plain.p(ctx, "unknown") == pytest.approx(1)


def test_no_training_rows_and_clashing_columns(spark):
    model, got = scored(spark, [], [row(1, "a b"), row(2, None)])
    assert model.tokens == 0 and got[1, 3].score == 0 and got[1, 3].n_known == 0
    model = K.train(clashing(spark, messy()))
    out = K.score(clashing(spark, messy()).withColumn("held_out", F.lit(False)), model)
    assert out.count() == len(messy()) and out.where("score is null or score > 0").count() == 0
    assert K.score(frame(spark, []).withColumn("held_out", F.lit(False)), model).count() == 0


def test_counts_above_one_byte(spark):
    train = [row(i, "a b " * 200) for i in range(5)]
    plain = Plain([r[1] for r in train])
    _, got = scored(spark, train, [row(1, "a b a b")])
    assert got[1, 5].score == pytest.approx(plain.score("a b a b"), rel=1e-9)
