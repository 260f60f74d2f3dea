"""Streaming: a fitted pipeline scores the file stream exactly like the batch."""

from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_stream_scores_equal_batch(spark):
    q = E.queries()
    a = q["stream_model_scores"](spark, SF)
    b = q["pipeline_roundtrip"](spark, SF).withColumnRenamed("p_positive", "q")
    j = a.join(b, "event_id")
    assert j.count() == b.count() > 0
    assert j.agg(F.max(F.abs(F.col("p_positive") - F.col("q")))).first()[0] == 0.0
    assert a.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_window_tally_only_closed_windows(spark):
    t = E.queries()["stream_window_tally"](spark, SF)
    ev = spark.read.parquet(f"{SF}/events.parquet")
    wm = ev.agg(F.max("ts")).first()[0]
    assert t.count() > 0
    assert t.agg(F.max("window_start")).first()[0] <= str(wm)


def test_late_rows_dropped_past_watermark(spark, tmp_path):
    """Three files arrive in order.  Spark filters late input with the
    watermark of two batches back (eviction uses the previous one), so rows of
    the third file that are older than the first file's watermark are
    dropped and their window is never counted."""
    import datetime as dt
    import time

    from voxlab.streaming.stream import EVENTS_SCHEMA, run_to_sink, tally_stream
    src = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    files = [
        [(i, t0 + dt.timedelta(minutes=7 * i), 1, "view", 10.0, "{}") for i in range(40)],           # 10:00-14:33
        [(500 + i, dt.datetime(2024, 1, 1, 15, 10 * i), 1, "view", 10.0, "{}") for i in range(3)],    # on time
        [(1000 + i, dt.datetime(2024, 1, 1, 1, 5, 0), 2, "view", 500.0, "{}") for i in range(5)],     # late
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, EVENTS_SCHEMA).coalesce(1).write.parquet(f"{src}/{k}")
        time.sleep(1.1)
    s = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
         .parquet(src).withColumn("ts", F.col("ts").cast("timestamp")))
    s = s.withColumn("result", F.when(F.col("value") / 613.0 > 0.5, "Parkinson's Risk").otherwise("Healthy"))
    t = tally_stream(s, "ts", "1 hour", "10 minutes").select(F.col("w.start").alias("start"), "result", "n")
    out = spark.read.parquet(run_to_sink(t, "late-test"))
    hours = {r.start.hour for r in out.collect()}
    assert 1 not in hours                      # the late window is dropped
    assert {10, 11, 12, 13} <= hours           # closed on-time windows are emitted
