"""Sinks that write once, windows with late rows, partial states, typed payloads, broken CSV lines, one-hot rows."""

import datetime as dt
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from arbiter.operators import audit as A
from arbiter.operators import audit_states as AS
from arbiter.operators import whatif as W
from arbiter.operators.scorer import LinearScorer, OneHotScorer, onehot_groups
from arbiter.sources import files
from arbiter.streaming import sinks as SK

T0 = dt.datetime(2024, 1, 1)
EVENTS = "ts timestamp, event_type string, value double"


def feed(spark, folder, schema, batches):
    """One file a batch, in order."""
    for i, b in enumerate(batches):
        time.sleep(1.05)  # the file source orders files by time
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{time.time_ns()}-{i}")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder))


def lost_after_write(monkeypatch, batch):
    """The driver is lost between the write of a batch and its commit."""
    run = SK._run

    def failing(stream, write, checkpoint):
        def once(df, n):
            write(df, n)
            if n == batch:
                raise RuntimeError("lost")
        run(stream, once, checkpoint)
    monkeypatch.setattr(SK, "_run", failing)


def test_records_are_written_once(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="arbiter-once-")
    schema = "ts timestamp, record_id long, text string"
    day = lambda n: T0 + dt.timedelta(days=n)
    first = [(day(0), 1, "a"), (day(0), 2, "b"), (day(1), 2, "another day"), (day(0), None, "x"), (None, 7, "no time")]
    again = [(day(0), 1, "a"), (day(0), 3, "c"), (day(0), 3, "c"), (None, 7, "no time"), (day(0), None, "x")]
    stream = feed(spark, f"{d}/src", schema, [first, again])
    with monkeypatch.context() as m:
        lost_after_write(m, 1)
        with pytest.raises(Exception, match="lost"):
            SK.append_once(stream, f"{d}/out", f"{d}/ck")
    want = sorted(map(str, [(day(0), 1, "a"), (day(0), 2, "b"), (day(1), 2, "another day"), (None, 7, "no time"), (day(0), 3, "c"), (day(0), None, "x"), (day(0), None, "x")]))
    rows = lambda: sorted(str(tuple(r)) for r in SK.records(spark, f"{d}/out").select("ts", "record_id", "text").collect())
    assert rows() == want
    SK.append_once(stream, f"{d}/out", f"{d}/ck")  # the last batch runs again
    assert rows() == want
    stream = feed(spark, f"{d}/src", schema, [first])  # a replayed file
    SK.append_once(stream, f"{d}/out", f"{d}/ck")
    assert len(rows()) == len(want) + 1  # the record without a key, which nothing identifies


def test_windows_and_late_rows(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="arbiter-late-")
    h = lambda n: T0 + dt.timedelta(hours=n)
    batches = [[(h(1), "a", 1.0), (h(2), "a", None), (h(3), None, 4.0)], [(h(50), "a", 5.0), (h(5), "a", 2.0)], [(h(6), "a", 100.0), (h(51), "b", 6.0), (None, "a", 9.0)],
               [(h(100), "a", 7.0)]]
    stream = feed(spark, f"{d}/src", EVENTS, batches)
    with monkeypatch.context() as m:
        lost_after_write(m, 3)
        with pytest.raises(Exception, match="lost"):
            SK.append_windows(stream, f"{d}/out", f"{d}/ck")

    def state():
        closed = sorted(map(str, SK.closed_windows(spark, f"{d}/out").collect()))
        return closed, sorted(map(str, SK.open_windows(spark, f"{d}/out").collect())), sorted(map(str, SK.late_rows(spark, f"{d}/out").collect()))
    closed, still, late = state()
    got = {(r["window_start"].day, r["event_type"]): (r["n"], r["avg_value"], r["sum_value"]) for r in SK.closed_windows(spark, f"{d}/out").collect()}
    # the row of hour 5 came in the batch that moved the watermark: in time; that of hour 6 after it: late
    assert got == {(1, "a"): (3, 1.5, 3.0), (1, None): (1, 4.0, 4.0), (3, "a"): (1, 5.0, 5.0), (3, "b"): (1, 6.0, 6.0)}
    assert [r["n"] for r in SK.open_windows(spark, f"{d}/out").collect()] == [1] and len(late) == 2
    SK.append_windows(stream, f"{d}/out", f"{d}/ck")
    assert state() == (closed, still, late)
    stream = feed(spark, f"{d}/src", EVENTS, [[(h(200), "a", 1.0)]])
    SK.append_windows(stream, f"{d}/out", f"{d}/ck")  # restarted: only the new batch
    assert len(SK.closed_windows(spark, f"{d}/out").collect()) == 5


def test_states_equal_the_full_aggregation(spark):
    r = random.Random(3)
    rows = [(T0 + dt.timedelta(hours=r.randrange(200)) if i % 9 else None, i, r.randrange(2), 0.5, r.choice([None, 0.6, 0.8, r.random()]), "m") for i in range(400)]
    preds = spark.createDataFrame(rows, "ts timestamp, id long, pred int, p double, confidence double, model string")
    log = A.prediction_events(preds, action=None)
    log = log.unionByName(A.threshold_events(spark.createDataFrame([(T0, "m", 0.5, 0.6)] * 3, "ts timestamp, model string, o double, n double"), "ts", "model", "o", "n"))
    path = tempfile.mkdtemp(prefix="arbiter-states-")
    for i in (0, 1, 2, 1):
        AS.append(log.where(F.pmod(F.coalesce("record_id", F.lit(0)), F.lit(3)) == i), path, i)
    got, want = AS.statistics(AS.merge(AS.load(spark, path))).first().asDict(), A.statistics(log).first().asDict()
    assert got.pop("avg_confidence") == pytest.approx(want.pop("avg_confidence")) and got == want
    days = AS.statistics(AS.merge(AS.load(spark, path), ["day"]), ["day"])
    assert days.agg(F.sum("total_predictions")).first()[0] == want["total_predictions"]
    conf = sorted(x[4] for x in rows if x[4] is not None)
    for q in AS.quantiles(AS.merge(AS.load(spark, path)), (0.1, 0.5, 0.9)).collect():
        below, upto = sum(c < q["confidence"] for c in conf) / len(conf), sum(c <= q["confidence"] for c in conf) / len(conf)
        assert below <= q["fraction"] + 0.01 and upto >= q["fraction"] - 0.01
    empty = tempfile.mkdtemp(prefix="arbiter-states-")
    AS.append(log.limit(0), empty, 0)
    assert AS.statistics(AS.merge(AS.load(spark, empty))).first()["total_records"] == 0 and AS.quantiles(AS.merge(AS.load(spark, empty)), (0.5,)).collect() == []


def test_typed_payloads(spark):
    df = spark.createDataFrame([(T0, 1, 2.5, 7, "x"), (None, 2, None, None, None)], "ts timestamp, record_id long, price double, n long, s string")
    new = df.select("ts", F.lit("prediction").alias("event_type"), "record_id", A.payload("price", "n", "s").alias("features"), F.lit(3).alias("later_field"))
    path = tempfile.mkdtemp(prefix="arbiter-typed-")
    A.append_typed(new, path)
    A.append_typed(df.select("ts", F.lit("prediction").alias("event_type"), F.lit(9).alias("record_id"), F.create_map(F.lit("price"), F.lit("2.50")).alias("features")), f"{path}-old")
    log = A.load_typed(spark, [path, f"{path}-old"])
    assert [f.name for f in A.TYPED_SCHEMA.fields] == log.columns
    text = {r[0]: r[1] for r in log.where("record_id < 9").select("record_id", F.to_json("features")).collect()}
    import json
    assert json.loads(text[1]) == {"price": 2.5, "n": 7, "s": "x"} and json.loads(text[2]).get("price") is None
    assert {r[0] for r in log.where("record_id = 9").select(F.to_json("features")).collect()} == {'{"price":"2.50"}'}
    assert {r[0] for r in log.select(F.try_variant_get("extra", "$.later_field", "int")).collect()} == {3, None}


def test_broken_csv_lines(spark):
    d = tempfile.mkdtemp(prefix="arbiter-csv-")
    for name, text in (("a", 'k,v,s\n1,2,x\n3,oops,y\n4\n5,6,"q, r"\n'), ("b", "k,v,s\n7,8.5,z\n9,1,too,many\n")):
        with open(f"{d}/{name}.csv", "w") as f:
            f.write(text)
    rows, broken = files.read_csv_checked(spark, d, "k int, v double, s string")
    assert sorted(map(tuple, rows.collect())) == [(1, 2.0, "x"), (5, 6.0, "q, r"), (7, 8.5, "z")]
    assert sorted(r[0] for r in broken.collect()) == ["3,oops,y", "4", "9,1,too,many"] and broken.where("file like '%.csv'").count() == 3
    plain = tempfile.mkdtemp(prefix="arbiter-csv-")
    for name, text in (("a", "k,v\n1,2\n"), ("b", "k,v\n3,4.5\n")):
        with open(f"{plain}/{name}.csv", "w") as f:
            f.write(text)
    rows, broken = files.read_csv_checked(spark, plain)
    assert dict(rows.dtypes)["v"] == "double" and rows.count() == 2 and broken.count() == 0


def test_onehot_rows_reach_a_model(spark):
    model = LinearScorer("m", {"x": 1.0, "cat": 0.5, "cat_b": -0.25}, -0.4)
    groups = onehot_groups(["x", "cat_a", "cat_b_u", "cat_b_v w", "cat_c", "other"], ["cat", "cat_b"])
    assert groups == {"cat": ["a", "c"], "cat_b": ["u", "v w"]}
    s = OneHotScorer(model, groups)
    assert s.features == ("x", "cat_a", "cat_c", "cat_b_u", "cat_b_v w")
    df = spark.createDataFrame([(1, 0.1, 0, 1, 0, 1), (2, 0.2, 1, 0, 0, 0), (3, 0.3, 0, 0, None, None)], "id long, x double, cat_a int, cat_c int, cat_b_u int, `cat_b_v w` int")
    coded = spark.createDataFrame([(1, 0.1, 1, 1), (2, 0.2, 0, 0), (3, 0.3, 0, 0)], "id long, x double, cat int, cat_b int")
    rows = lambda a, d: sorted((r["id"], r["p"], r["pred"]) for r in a.apply(d).collect())
    assert rows(s, df) == rows(model, coded)
    scen = spark.createDataFrame([(1, "cat", " c "), (1, "cat_b", "v w"), (2, "cat", "new"), (3, "cat", None)], "scenario_id long, feature string, value string")
    base = spark.createDataFrame([(i, i / 10) for i in (1, 2, 3)], "scenario_id long, x double")
    wide = W.onehot_rows(scen, base, ["x"], groups)
    assert {r["scenario_id"]: (r["cat_a"], r["cat_c"], r["cat_b_u"], r["cat_b_v w"]) for r in wide.collect()} == {1: (0, 1, 0, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}
    assert W.predict(wide, s).count() == 3
