"""ST1-ST3 on Structured Streaming.

* ``score_stream``: arriving feature rows -> scorer (any DataFrame ->
  DataFrame function that works on streams, e.g. a ``PipelineModel``
  transform) -> append sink with a checkpoint in the shared folder;
* ``tally_stream``: running totals per tumbling window and result, with a
  watermark so state is bounded and late rows are dropped;
* ``session_tally_stream``: the same per user session (``session_window``).

``events.ts`` is ``TIMESTAMP_NTZ`` in the test data; ``withWatermark`` needs
``timestamp``, so it is cast (session time zone UTC).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..session import scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """``events`` as a file stream (only ``events.parquet`` of the folder)."""
    s = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
         .option("maxFilesPerTrigger", max_files).parquet(sf_dir))
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_sink(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet") -> str:
    """Run a streaming frame over all available input into a file sink in the
    shared folder; returns the sink path (checkpoint next to it)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"stream-{name}")
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", path + "-checkpoint")
         .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return path


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], name: str = "scores") -> str:
    """ST1: score rows as they arrive; append to a Parquet sink."""
    return run_to_sink(scorer(stream), name)


def tally_stream(stream: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes",
                 result: str = "result", positive: str = C.RESULT_POSITIVE) -> DataFrame:
    """ST2: per tumbling window and result: rows and at-risk rows.

    Append mode emits a window once the watermark (max event time minus
    ``delay``) passes its end.  Spark drops input rows older than the
    watermark of two batches back (state eviction uses the previous batch's),
    so a late row is still counted if it arrives in the batch right after the
    watermark moved; later ones are dropped.
    """
    return (stream.withWatermark(ts, delay)
            .groupBy(F.window(ts, width).alias("w"), result)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(result) == positive).alias("at_risk")))


def session_tally_stream(stream: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes",
                         delay: str = "10 minutes", result: str = "result",
                         positive: str = C.RESULT_POSITIVE) -> DataFrame:
    """ST3: totals per user session (a session ends after ``gap`` without rows)."""
    return (stream.withWatermark(ts, delay)
            .groupBy(F.session_window(ts, gap).alias("w"), user)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(result) == positive).alias("at_risk")))
