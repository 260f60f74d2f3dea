"""Readers for the test tables and the stand-ins that play the fixtures.

The screening fixtures (labelled set, longitudinal set, f0 frames, pulses)
are not shipped; these adapters derive them from the driver's tables with
plain DataFrame work so that every registered query grows with its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import exact_rank, refined_bucket

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Feature columns of the labelled stand-in (events).
EVENT_FEATURES = ["value", "hour", "k", "user_n", "user_mean"]
EVENT_KEY = "event_id"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled stand-in: one row per event, ``status`` = purchase.

    Features: ``value``, hour of ``ts``, the number in ``props`` and two
    per-user aggregates (row count and mean value).  The per-user table is
    an aggregate joined back on ``user_id`` (Spark broadcasts it only when
    its estimated size is under the threshold; AQE splits a hot user).
    """
    ev = read_table(spark, sf_dir, "events")
    users = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_n"), F.avg("value").alias("user_mean"))
    users = users.withColumnRenamed("user_id", "_vx_user")  # rows without a user are a user of their own
    # numbers before the join, whose shuffle then carries no text
    own = ev.select("event_id", "user_id",
                    (F.col("event_type") == "purchase").cast("int").alias("status"),
                    F.col("value").cast("double").alias("value"),
                    F.hour("ts").cast("double").alias("hour"),
                    F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return (own.join(users, F.col("user_id").eqNullSafe(F.col("_vx_user")))
            .select(*own.columns, F.col("user_n").cast("double").alias("user_n"),
                    F.col("user_mean").cast("double").alias("user_mean")))


def longitudinal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudinal stand-in: subject = ``o_custkey``, target = ``o_totalprice``."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey"), F.col("o_custkey").alias("subject"),
                    F.col("o_totalprice").alias("target"),
                    F.year("o_orderdate").cast("double").alias("year"),
                    F.month("o_orderdate").cast("double").alias("month"),
                    F.dayofweek("o_orderdate").cast("double").alias("dow"),
                    F.substring("o_orderpriority", 1, 1).try_cast("double").alias("priority"),
                    (F.col("o_orderstatus") == "F").cast("double").alias("is_f"))


def series_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f0-frame stand-in: ``(recording_id, frame_idx, f0)`` from ``events``.

    recording = ``user_id``; frame index = 1-based position by ``(ts,
    event_id)`` inside the user, computed with the bucketed exact rank (no
    whole-user window); f0 = ``value``.
    """
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    # buckets of ten days, of which most users have a few rows each; one holding
    # more than a million rows of a user is split into milliseconds
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = refined_bucket(ev, ["user_id"], micros, 10 * 86_400_000_000, 1_000)
    r = exact_rank(ev, ["user_id"], ["ts", "event_id"], F.col("_vx_rb"), out="frame_idx").drop("_vx_rb")
    return r.select(F.col("user_id").alias("recording_id"), F.col("frame_idx").cast("long"),
                    F.col("value").cast("double").alias("f0"))


def pulses_from_frames(fr: DataFrame) -> DataFrame:
    """Pulse stand-in from frames: ``t`` = running sum of ``0.004 + f0/1e5``, ``amp`` = f0."""
    from ..operators.ordering import prefix_sums, block_bucket
    p = prefix_sums(fr, ["recording_id"], ["frame_idx"], block_bucket(F.col("frame_idx")),
                    {"t": F.lit(0.004) + F.col("f0") / F.lit(1e5)})
    return p.select("recording_id", F.col("frame_idx").alias("pulse_idx"), "t", F.col("f0").alias("amp"))


def series_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse stand-in over ``events`` (see ``pulses_from_frames``)."""
    return pulses_from_frames(series_frames(spark, sf_dir))
