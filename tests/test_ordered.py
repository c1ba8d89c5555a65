"""The two-level ordered scan equals a plain window; exact quantiles equal NumPy."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from arbiter.operators.ordered import hash_rank, running_sums, top_k
from arbiter.operators.stats import exact_quantiles


def test_running_sums_matches_window(spark):
    rows = [(g, float((i * 37) % 101), (i % 5)) for g in ("a", "b") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, v int")
    d = df.groupBy("g", "x").agg(F.sum("v").alias("v"))
    got = {(r["g"], r["x"]): (r["cum_v"], r["next_v"]) for r in
           running_sums(d, ["g"], "x", ["v"], buckets=8, lead_cols=["v"]).collect()}
    w = Window.partitionBy("g").orderBy("x")
    exp = {(r["g"], r["x"]): (r["c"], r["n"]) for r in
           d.select("g", "x", F.sum("v").over(w).alias("c"), F.lead("v").over(w).alias("n")).collect()}
    assert got == exp


def test_hash_rank_is_row_number(spark):
    df = spark.range(2000).withColumn("h", F.md5(F.col("id").cast("string"))).withColumn("k", F.col("id") % 3)
    got = {r["id"]: r["rank"] for r in hash_rank(df, ["k"], "h", "id").collect()}
    w = Window.partitionBy("k").orderBy("h", "id")
    exp = {r["id"]: r["r"] for r in df.select("id", F.row_number().over(w).alias("r")).collect()}
    assert got == exp


def test_exact_quantiles_numpy(spark):
    vals = [float((i * 7) % 97) for i in range(1001)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    qs = [0.1, 0.25, 0.5, 0.9]
    got = {r["q_idx"]: r["q"] for r in exact_quantiles(df, "x", qs).collect()}
    for j, q in enumerate(qs):
        assert got[j] == pytest.approx(np.quantile(vals, q))


def test_top_k_exact(spark):
    rows = [("c", f"v{i:03d}", (i * 13) % 50) for i in range(300)]
    df = spark.createDataFrame(rows, "col string, value string, count int")
    got = [(r["value"], r["count"]) for r in
           top_k(df, ["col"], [F.col("count").desc(), F.col("value")], 5, "value", buckets=7).orderBy("rank").collect()]
    exp = sorted(((v, c) for _, v, c in rows), key=lambda t: (-t[1], t[0]))[:5]
    assert got == exp


def test_hot_score_value_stays_exact(spark):
    """One score value holds a third of the rows: curves and AUC stay exact."""
    from arbiter.operators import threshold
    rows = []
    for i in range(900):
        p = 0.42 if i % 3 == 0 else ((i * 7919) % 1000) / 1000.0
        y = 1 if ((i * 104729) % 1000) / 1000.0 < p else 0
        rows.append((i, "m", y, p))
    df = spark.createDataFrame(rows, "id long, model string, y int, p double")
    pos = [p for _, _, y, p in rows if y == 1]
    neg = [p for _, _, y, p in rows if y == 0]
    exp = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert threshold.roc_auc(df).first()["roc_auc"] == pytest.approx(exp)
    pr = threshold.pr_curve(df).where("threshold = 0.42").first()
    tp = sum(1 for _, _, y, p in rows if p >= 0.42 and y == 1)
    fp = sum(1 for _, _, y, p in rows if p >= 0.42 and y == 0)
    assert pr["precision"] == pytest.approx(tp / (tp + fp))


def test_dominant_class_split(spark):
    """A class with 90 % of the rows is split over many window partitions, exactly."""
    import math
    from arbiter.operators.prep import stratified_split
    df = spark.range(3000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    s = stratified_split(df, "id", "y")
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got[(0, "test")] == math.ceil(0.2 * 2700) and got[(1, "test")] == math.ceil(0.2 * 300)
