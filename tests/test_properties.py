"""Property tests: the bucketed threshold sweep equals the per-threshold definition,
including scores exactly on a threshold (i * 0.01 is not exact in binary)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from arbiter.operators import threshold

scores = st.one_of(st.floats(min_value=-0.2, max_value=1.2, allow_nan=False),
                   st.integers(min_value=0, max_value=100).map(lambda i: i * 0.01),
                   st.integers(min_value=0, max_value=100).map(lambda i: i / 100.0))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(scores, st.integers(min_value=0, max_value=1)), min_size=1, max_size=60))
def test_sweep_matches_definition(spark, rows):
    df = spark.createDataFrame([(i, "m", y, p) for i, (p, y) in enumerate(rows)],
                               "id long, model string, y int, p double")
    got = {r["i"]: (r["tp"], r["fp"]) for r in threshold.threshold_counts(df).collect()}
    for i in range(101):
        t = i * 0.01
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        fp = sum(1 for p, y in rows if p >= t and y == 0)
        assert got[i] == (tp, fp), (i, t)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-5, max_value=5).map(float),
                          st.floats(min_value=-10, max_value=10, allow_nan=False)), min_size=1, max_size=80))
def test_exact_quantiles_match_numpy(spark, vals):
    import numpy as np

    from arbiter.operators.stats import exact_quantiles
    clean = [v for v in vals if v is not None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["q_idx"]: r["q"] for r in exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    if not clean:
        assert got == {}
        return
    for j, q in enumerate([0.0, 0.25, 0.5, 0.9, 1.0]):
        assert abs(got[j] - float(np.quantile(clean, q))) <= 1e-9 * max(1.0, abs(got[j]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(min_value=0, max_value=6).map(lambda i: i / 6), st.integers(0, 1)),
                min_size=2, max_size=60))
def test_auc_matches_pairwise_with_ties(spark, rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    df = spark.createDataFrame([(i, "m", y, p) for i, (p, y) in enumerate(rows)], "id long, model string, y int, p double")
    got = threshold.roc_auc(df).first()["roc_auc"]
    if not pos or not neg:
        assert got is None
        return
    exp = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12
