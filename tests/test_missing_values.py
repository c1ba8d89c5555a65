"""Null keys and labels, NaN, constant columns, empty tables, folders of part files: no row is lost, nothing raises."""

import pytest
from pyspark.sql import functions as F

from arbiter.operators import audit as A
from arbiter.operators import confidence as C
from arbiter.operators import prep
from arbiter.operators import profile as P
from arbiter.operators import quality as Q
from arbiter.operators import threshold as T
from arbiter.operators.ordered import hash_rank, running_sums
from arbiter.session import scratch_path
from arbiter.sources.tables import load
from arbiter.streaming import audit_stats as ST
from arbiter.streaming import decisions as SD

NAN = float("nan")


def test_ordered_scan_keeps_null_groups_keys_and_order_values(spark):
    rows = [(i if i % 10 else None, None if i % 4 == 0 else i % 3, None if i % 7 == 0 else float(i), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g int, v double, one int")
    out = running_sums(df, ["g"], "v", ["one"], totals=True)
    assert out.count() == 200
    by = {r["g"]: r for r in out.groupBy("g").agg(F.count("*").alias("n"), F.max("cum_one").alias("m"), F.max("tot_one").alias("t")).collect()}
    assert all(r["n"] == r["m"] == r["t"] for r in by.values()) and None in by
    ranked = hash_rank(df.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], "h", "v", "r")
    assert ranked.count() == 200


def test_split_encode_and_batches_keep_every_row(spark):
    n = spark.createDataFrame([(i if i % 10 else None, None if i % 5 == 0 else i % 2) for i in range(100)], "id long, y int")
    assert prep.stratified_split(n).count() == 100
    assert [r["y"] for r in prep.encode_target(spark.createDataFrame([(None,)] * 3, "t string"), "t").collect()] == [None] * 3
    ev = spark.createDataFrame([(i if i % 3 else None, None if i % 4 == 0 else i % 3, 1, .5, .5, "m", "a") for i in range(40)],
                               "id long, b int, pred int, p double, confidence double, model string, action string")
    ev = A.batch_events(ev.withColumn("ts", F.when(F.col("id") % 2 == 0, F.current_timestamp())), F.col("b"))
    assert ev.count() == 40


def test_more_categories_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_CATEGORIES", 5)
    df = spark.createDataFrame([(i, f"k{i % 40:03d}" if i % 11 else None) for i in range(200)], "id long, c string")
    got = {r["id"]: r["c"] for r in prep.label_encode(df, ["c"]).collect()}
    names = sorted({f"k{i % 40:03d}" for i in range(200) if i % 11} | {"nan"})
    assert got == {i: names.index(f"k{i % 40:03d}" if i % 11 else "nan") for i in range(200)}


def test_constant_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(float(i % 3), 1.0, i % 2) for i in range(20)], "a double, k double, y int")
    e = d.limit(0)
    assert Q.leakage(d, ["a", "k"]).collect() == [] and Q.outliers(d, ["a", "k"]).collect() == []
    for x in (d, e):
        assert Q.report(x, x, ["a", "k"]).count() == 1 and Q.summary(Q.report(x, x, ["a", "k"])).count() == 1
        assert P.summary(x).count() == 3 and Q.missing(x).collect() == []
    assert P.drop_missing(e).count() == 0 and P.total_missing(e).first()[0] == 0
    one = C.reliability(spark.createDataFrame([(1, [1.0])], "id long, prob array<double>")).first()
    assert one["uncertainty"] is None and one["probability_confidence"] == 1.0


def test_nan_is_missing(spark):
    path = scratch_path(spark, "nan")
    spark.createDataFrame([(NAN, 1), (1.0, 0), (2.0, 1), (3.0, 0)], "v double, y int").write.parquet(f"{path}/t.parquet")
    df = load(spark, path, "t")
    r = P.numeric_info(df, ["v"]).first()
    assert (r["missing"], r["mean"], r["max"], r["unique_count"]) == (1, 2.0, 3.0, 3)
    leak = df.withColumn("same", F.col("v")).withColumn("y", F.col("v"))
    assert {x["feature"] for x in Q.leakage(leak, ["same"]).collect()} == {"same"}


def test_one_rule_for_missing_scores_and_labels(spark):
    s = spark.createDataFrame([("m", 1, NAN), ("m", 1, None), ("m", 0, 0.7), ("m", None, 0.9), ("m", 1, 0.8)], "model string, y int, p double")
    at = T.compare_thresholds(s, [0.5]).first()
    sweep = T.analyze_thresholds(s).where("threshold = 0.5").first()
    for r in (at, sweep):
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (1, 1, 0, 2)
    assert T.roc_auc(s).first()["roc_auc"] == pytest.approx(1 / 3)  # the missing scores rank last


@pytest.mark.parametrize("folder", [True, False])
def test_streams_read_folders_and_files(spark, folder):
    src = "/root/testdata/sf0.001"
    if folder:
        src = scratch_path(spark, "parts")
        for t in ("events", "orders"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(4).write.parquet(f"{src}/{t}.parquet")
    name = f"stats_{folder}"
    ST.run_complete(ST.windowed_stats(ST.event_stream(spark, src, "events")), name)
    assert spark.table(name).agg(F.sum("n")).first()[0] == load(spark, src, "events").count()
    outcomes = spark.createDataFrame([("o", "act", "wait")], "outcome string, positive_action string, negative_action string")
    st = SD.decision_stream(spark, src, "orders", lambda d: F.lit(0.7), "o_orderkey", "o_orderdate", "o", outcomes, "m")
    out, ck = scratch_path(spark, "dec"), scratch_path(spark, "dec-ck")
    SD.run_to_table(st, out, ck)
    assert spark.read.parquet(out).count() == load(spark, src, "orders").count()


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from arbiter import session
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None, set=lambda k, v: None),
                           sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(fake)


def test_small_operators(spark):
    """Distinct counts in one pass, factorised codes, dense confusion, subgroup AUC, registry, previews."""
    from arbiter.operators import evaluate as E
    from arbiter.operators import registry as R
    df = spark.createDataFrame([(1, "b", 0.0, 1, 0, .9), (2, "a", -0.0, 1, 0, .2), (3, None, None, 0, 0, .4), (4, "b", 5.0, 0, 0, .1)],
                               "id long, s string, v double, y int, pred int, p double")
    assert {r["column_name"]: r["unique"] for r in P.distinct_counts(df, ["s", "v", "id"]).collect()} == {"s": 2, "v": 2, "id": 4}
    assert {r["id"]: r["code"] for r in prep.factorize(df, "s", "id").collect()} == {1: 0, 2: 1, 3: -1, 4: 0}
    leak = df.select("id", F.when(F.col("y") == 1, "q").otherwise("r").alias("t"), F.col("y").cast("double").alias("f"))
    assert Q.leakage(leak, ["f"], "t").first()["feature"] == "f"
    d = E.confusion_dense(df.withColumn("model", F.lit("m")).withColumn("pred", F.lit(1)))
    assert {(r["actual"], r["predicted"]): r["count"] for r in d.collect()} == {(0, 0): 0, (0, 1): 2, (1, 0): 0, (1, 1): 2}
    g = E.by_subgroup(df.withColumn("model", F.lit("m")), F.lit("all"), score="p").first()
    assert g["n"] == 4 and g["roc_auc"] == pytest.approx(0.75)
    path = scratch_path(spark, "registry")
    for k, day in (("a", "2024-01-01"), ("a", "2024-02-01"), ("b", "2024-01-15")):
        R.register(spark.createDataFrame([(k, day)], "model string, trained_at string"), path)
    assert R.history(spark, path, "a").count() == 2
    assert {r["model"]: r["trained_at"] for r in R.latest(spark, path).collect()} == {"a": "2024-02-01", "b": "2024-01-15"}
    assert [r["value"] for r in P.preview(df, "s", "id", 2).collect()] == ["b", "a"]
    yn = df.select(prep.yes_no(F.lit("Yes")).alias("a"), prep.yes_no(F.lit("No")).alias("b"), prep.yes_no(F.lit("7")).alias("c"), prep.yes_no(F.lit("x")).alias("d")).first()
    assert tuple(yn) == (1, 0, 7, None)
    two = spark.createDataFrame([("yes", "a"), ("no", "yes"), ("yes", "z")], "t string, three string")
    pos = {r["target"]: (r["positive_label"], r["inferred"]) for r in prep.positive_label(two, ["t", "three"]).collect()}
    assert pos == {"t": ("yes", True), "three": ("a", False)}
    assert {r["feature"]: r["mean"] for r in prep.scaler_table(df, ["p"]).collect()} == {"p": pytest.approx(0.4)}
