"""Preparation and data-quality invariants."""

import math

import pytest
from pyspark.sql import functions as F

from arbiter.functions.formatting import human_readable
from arbiter.operators import prep as P
from arbiter.operators import profile as G
from arbiter.operators import quality as Q


def _frame(spark, n=300):
    rows = []
    for i in range(n):
        y = 1 if i % 4 == 0 else 0
        rows.append((i, float((i * 37) % 100), float((i * 11) % 7), ["A", "B", "C"][i % 3], y,
                     y + ((i * 7919) % 100) / 1000.0 - 0.05))
    return spark.createDataFrame(rows, "id long, f1 double, f2 double, cat string, y int, leaky double")


def test_stratified_split_counts(spark):
    df = _frame(spark)
    s = P.stratified_split(df, "id", "y")
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for cls, n in ((1, 75), (0, 225)):
        assert got[(cls, "test")] == math.ceil(0.2 * n)
        assert got[(cls, "train")] == n - math.ceil(0.2 * n)


def test_label_encode_sorted_codes(spark):
    enc = {(r["feature"], r["label"]): r["code"] for r in P.encoder_table(_frame(spark), ["cat"]).collect()}
    assert enc == {("cat", "A"): 0, ("cat", "B"): 1, ("cat", "C"): 2}


def test_standardize_population_std(spark):
    z = P.standardize(_frame(spark).select("id", "f1"), ["f1"])
    r = z.agg(F.avg("f1").alias("m"), F.stddev_pop("f1").alias("s")).first()
    assert r["m"] == pytest.approx(0.0, abs=1e-12) and r["s"] == pytest.approx(1.0)


def test_leakage_found(spark):
    out = {r["feature"]: r["risk_level"] for r in Q.leakage(_frame(spark), ["f1", "f2", "leaky"]).collect()}
    assert out == {"leaky": "CRITICAL"}


def test_drift_same_sample_is_zero(spark):
    df = _frame(spark)
    r = Q.drift(df, df, ["f1"]).first()
    assert r["ks_statistic"] == 0.0 and r["p_value"] == pytest.approx(1.0) and not r["drifted"]


def test_drift_shifted(spark):
    a = _frame(spark)
    b = a.withColumn("f1", F.col("f1") + 50)
    r = Q.drift(a, b, ["f1"]).first()
    assert r["ks_statistic"] == pytest.approx(0.5) and r["drifted"]


def test_missing_and_drop(spark):
    df = _frame(spark).withColumn("f2", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("f2"))) \
        .withColumn("f1", F.when(F.col("id") % 4 != 0, None).otherwise(F.col("f1")))
    m = {r["feature"]: r["severity"] for r in Q.missing(df).collect()}
    assert m == {"f1": "High", "f2": "Medium"}
    cleaned = G.drop_missing(df)
    assert "f1" not in cleaned.columns and cleaned.where(F.col("f2").isNull()).count() == 0


def test_rank_targets_bands(spark):
    r = {x["column_name"]: x["rank"] for x in G.rank_targets(_frame(spark)).collect()}
    assert r["y"] == 1 and r["cat"] == 2 and r["id"] == 4


def test_human_readable_branches(spark):
    rows = [("monthly_charge", 1234.5), ("churn_rate", 12.34), ("num_orders", 2.5), ("tenure", 3.4),
            ("customer_age", 40.6), ("score", 0.123)]
    df = spark.createDataFrame(rows, "f string, v double")
    got = {r["f"]: r["d"] for r in df.select("f", human_readable(F.col("f"), F.col("v")).alias("d")).collect()}
    assert got == {"monthly_charge": "$1,234.50", "churn_rate": "12.3%", "num_orders": "2",
                   "tenure": "3 months", "customer_age": "41 years", "score": "0.12"}


def test_profile_approx_close_to_exact(spark):
    df = _frame(spark, 2000)
    ex = {r["column_name"]: r for r in G.numeric_info(df, ["f1", "f2"]).collect()}
    ap = {r["column_name"]: r for r in G.numeric_info(df, ["f1", "f2"], approx=True).collect()}
    for c in ("f1", "f2"):
        assert abs(ap[c]["unique_count"] - ex[c]["unique_count"]) <= max(2, 0.05 * ex[c]["unique_count"])
        assert abs(ap[c]["median"] - ex[c]["median"]) <= 1.0


def test_view_choice_rules(spark):
    import datetime as dt
    rows = [(i, f"user{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 4, float(i) * 1.5,
             f"c{i % 30}", ["a", "b"][i % 2], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "order_id long, name string, ts timestamp, small int, amount double, "
                                     "wide string, narrow string, y int")
    v = {r["column_name"]: r["view_type"] for r in G.view_choice(df, "y").collect()}
    assert v["order_id"] == "none" and v["name"] == "none"          # id-like
    assert v["small"] == "bar_counts" and v["y"] == "bar_counts"   # discrete numeric
    assert v["amount"] == "none"                                     # every value distinct -> id-like
    assert v["wide"] == "topn_bar" and v["narrow"] == "grouped_bar"
    assert v["ts"] == "none"                                         # unique timestamps are id-like first


def test_encode_target_explicit_and_inferred(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, "No"), (3, None)], "id long, t string")
    inf = {r["id"]: r["y"] for r in P.encode_target(df, "t").collect()}
    assert inf == {1: 1, 2: 0, 3: None}
    exp = {r["id"]: r["y"] for r in P.encode_target(df, "t", positive="No").collect()}
    assert exp == {1: 0, 2: 1, 3: None}


def test_card_completeness(spark):
    from arbiter.operators import registry as R
    meta = spark.createDataFrame([("m1", "T", 0.9, 0.8, 0.7), ("m2", "T", 0.6, 0.5, 0.4)],
                                 "model string, model_type string, accuracy double, f1 double, roc_auc double") \
        .withColumn("feature_count", F.lit(3))
    facts = spark.createDataFrame([(100, 80, 20)], "n_rows long, n_train long, n_test long")
    texts = {"m1": {s: "x" for s in R.CARD_SECTIONS}, "m2": {"intended_use": "x"}}
    got = {r["model"]: r for r in R.completeness(R.card(meta, facts, texts)).collect()}
    assert got["m1"]["sections_present"] == 7 and got["m1"]["sections_missing"] == ""
    assert got["m2"]["sections_present"] == 4
    assert got["m2"]["sections_missing"] == "ethical_considerations,limitations,recommendations"


def test_daily_counts_fill_gaps(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame([(t,), (t + dt.timedelta(hours=1),), (t + dt.timedelta(days=2),)], "ts timestamp_ntz")
    got = [(r["day"].day, r["count"]) for r in G.daily_counts(df, "ts").orderBy("day").collect()]
    assert got == [(1, 2), (2, 0), (3, 1)]


def test_top_n_other_accounts_for_all_rows(spark):
    df = spark.createDataFrame([(f"v{i % 30}",) for i in range(300)] + [(None,)] * 5, "c string")
    rows = G.top_n_other(df, "c", 20).collect()
    assert len(rows) == 21 and sum(r["count"] for r in rows) == 305
    assert [r for r in rows if r["value"] == "Other"][0]["count"] == 305 - sum(
        r["count"] for r in rows if r["value"] != "Other")


def test_exact_ks_equals_counted_paths():
    """All orders of two small samples, counted."""
    import itertools
    from math import comb

    from arbiter.operators.quality import exact_ks
    for n1, n2 in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 4), (7, 1)):
        ds = []
        for at in itertools.combinations(range(n1 + n2), n1):
            i = j = 0
            d = 0
            for k in range(n1 + n2):
                i, j = (i + 1, j) if k in at else (i, j + 1)
                d = max(d, abs(i * n2 - j * n1))
            ds.append(d)
        for d in sorted(set(ds)):
            assert abs(exact_ks(d / (n1 * n2), n1, n2) - sum(x >= d for x in ds) / comb(n1 + n2, n1)) < 1e-12
    assert exact_ks(0.0, 5, 5) == 1.0 and exact_ks(1.0, 3, 3) == 0.1
    # the two forms meet for large samples, and a small probability keeps its digits
    assert abs(exact_ks(0.03, 5000, 4000) - 0.03531) < 2e-3
    assert 0 < exact_ks(0.9, 60, 50) < 1e-20


def test_drift_by_group_and_odd_sides(spark):
    import random

    from arbiter.operators import quality as Q
    r = random.Random(5)
    rows = [(g, r.gauss(0, 1) if r.random() < 0.8 else None, r.gauss(0, 1), None) for g in ("a", "b", None) for _ in range(60)]
    tr = spark.createDataFrame(rows, "g string, x double, y double, z double")
    te = spark.createDataFrame([(g, (x or 0.0) + 1, y, z) for g, x, y, z in rows[::2]], tr.schema)
    every = {(x["g"], x["feature"]): x for x in Q.drift(tr, te, ["x", "y", "z"], by=["g"]).collect()}
    assert len(every) == 9
    for g in ("a", "b", None):
        same = F.col("g").eqNullSafe(F.lit(g))
        for one in Q.drift(tr.where(same), te.where(same), ["x", "y", "z"]).collect():
            mine = every[g, one["feature"]].asDict()
            mine.pop("g")
            assert mine == one.asDict()
        assert every[g, "x"]["drifted"] and every[g, "z"]["p_value"] is None
    far = Q.drift(tr, te, ["y"], exact_up_to=0).first()  # the series instead
    near = Q.drift(tr, te, ["y"]).first()
    assert far["ks_statistic"] == near["ks_statistic"] and abs(far["p_value"] - near["p_value"]) < 0.05
    assert Q.drift(tr.limit(0), te, ["y"]).first()["p_value"] is None
