"""Streaming equals batch; append mode drops records later than the watermark."""

import datetime as dt
import tempfile
import time

from pyspark.sql import functions as F

from arbiter.streaming import audit_stats as ST


def test_append_mode_watermark_drops_late_rows(spark):
    d = tempfile.mkdtemp(prefix="arbiter-stream-")
    t = dt.datetime(2024, 1, 1)
    batches = [
        [(t + dt.timedelta(hours=1), "a", 1.0), (t + dt.timedelta(hours=2), "a", 2.0)],
        [(t + dt.timedelta(days=2), "a", 5.0)],            # advances the watermark past day 1
        [(t + dt.timedelta(days=2, hours=1), "a", 6.0)],   # one more batch: late filter uses the previous one
        [(t + dt.timedelta(hours=3), "a", 100.0)],         # late for day 1: dropped
        [(t + dt.timedelta(days=4), "a", 7.0)],            # closes day 3
    ]
    schema = "ts timestamp, event_type string, value double"
    for i, b in enumerate(batches):
        # distinct modification times give the file source a fixed order
        time.sleep(1.1)
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{d}/src/part{i}")
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{d}/src"))
    stats = ST.windowed_stats(src)
    q = (stats.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{d}/ck")
         .trigger(availableNow=True).start(f"{d}/out"))
    q.awaitTermination()
    out = {r["window_start"].day: (r["n"], r["sum_value"])
           for r in ST.flatten(spark.read.parquet(f"{d}/out")).collect()}
    assert out[1] == (2, 3.0)          # the late 100.0 was not added
    assert 5 not in out                # the last window is still open


def test_complete_mode_equals_batch(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=h), "a" if h % 2 else "b", float(h)) for h in range(60)]
    d = tempfile.mkdtemp(prefix="arbiter-stream-")
    import pandas as pd
    # one parquet file, like the driver's tables
    pd.DataFrame(rows, columns=["ts", "event_type", "value"]).to_parquet(f"{d}/events.parquet", index=False,
                                                                         coerce_timestamps="us")
    ST.run_complete(ST.windowed_stats(ST.event_stream(spark, d, "events")), "t_events_complete")
    got = {(r["window_start"].day, r["event_type"]): r["n"] for r in ST.flatten(spark.table("t_events_complete")).collect()}
    exp = {}
    for ts, e, _ in rows:
        exp[(ts.day, e)] = exp.get((ts.day, e), 0) + 1
    assert got == exp
