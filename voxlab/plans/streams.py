"""Streaming queries over ``events`` read as a file stream (availableNow).

Append mode emits a window or session once the watermark (max event time
minus the delay) has passed its end; the oracle keeps the same closed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.project import result_text
from ..session import cut_lineage
from ..streaming.stream import events_stream, run_to_sink, score_stream, session_tally_stream, tally_stream

DIVISOR = 613.0


def _scorer(df: DataFrame) -> DataFrame:
    p = df.withColumn("p_positive", F.col("value") / F.lit(DIVISOR))
    p = p.withColumn("prediction", (F.col("p_positive") > 0.5).cast("int"))
    return result_text(p, "prediction")


def q_stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    path = score_stream(events_stream(spark, sf), lambda s: _scorer(s).select(
        "event_id", "user_id", F.round("p_positive", 6).alias("p_positive"), "prediction", "result"), "scores")
    return spark.read.parquet(path)


SQL_STREAM_SCORES = f"""
SELECT event_id, user_id, round(value / {DIVISOR}, 6) AS p_positive, CAST(value / {DIVISOR} > 0.5 AS INTEGER) AS prediction,
       CASE WHEN value / {DIVISOR} > 0.5 THEN 'Parkinson''s Risk' ELSE 'Healthy' END AS result FROM events"""


def q_stream_window_tally(spark: SparkSession, sf: str) -> DataFrame:
    t = tally_stream(_scorer(events_stream(spark, sf)), "ts", "1 hour", "10 minutes")
    t = t.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "result", "n", "at_risk")
    return spark.read.parquet(run_to_sink(t, "window-tally"))


SQL_STREAM_WINDOW_TALLY = f"""
WITH s AS (SELECT ts, CASE WHEN value / {DIVISOR} > 0.5 THEN 'Parkinson''s Risk' ELSE 'Healthy' END AS result,
                  CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h FROM events),
wm AS (SELECT epoch_us(max(ts)) - 600000000 AS wm FROM events)
SELECT strftime(make_timestamp(h * 3600000000), '%Y-%m-%d %H:%M:%S') AS window_start, result,
       count(*) AS n, CAST(count_if(result = 'Parkinson''s Risk') AS BIGINT) AS at_risk
FROM s, wm GROUP BY h, result, wm.wm HAVING (h + 1) * 3600000000 <= wm.wm"""


def q_stream_session_tally(spark: SparkSession, sf: str) -> DataFrame:
    t = session_tally_stream(_scorer(events_stream(spark, sf)), "ts", "user_id", "30 minutes", "10 minutes")
    t = t.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                 F.date_format("w.end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "n", "at_risk")
    return spark.read.parquet(run_to_sink(t, "session-tally"))


SQL_STREAM_SESSION_TALLY = f"""
WITH s AS (SELECT user_id, epoch_us(ts) AS t, CAST(value / {DIVISOR} > 0.5 AS INTEGER) AS pos FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS new_s FROM s),
k AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g),
ss AS (SELECT user_id, sid, min(t) AS st, max(t) + 1800000000 AS en, count(*) AS n, CAST(sum(pos) AS BIGINT) AS at_risk
       FROM k GROUP BY 1, 2),
wm AS (SELECT epoch_us(max(ts)) - 600000000 AS wm FROM events)
SELECT user_id, strftime(make_timestamp(st), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(make_timestamp(en), '%Y-%m-%d %H:%M:%S.%f') AS session_end, n, at_risk
FROM ss, wm WHERE en <= wm.wm"""

QUERIES = {
    "stream_scores": (q_stream_scores, SQL_STREAM_SCORES),
    "stream_window_tally": (q_stream_window_tally, SQL_STREAM_WINDOW_TALLY),
    "stream_session_tally": (q_stream_session_tally, SQL_STREAM_SESSION_TALLY),
}


def q_stream_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 with a fitted pipeline (scaler stage, assembler, logistic
    regression) applied to the file stream; arriving rows are enriched with
    the per-user aggregates by a stream-static join.  Rows-only check."""
    from ..operators.project import split_probability
    from ..sources.tables import read_table
    from .learning import _fit_pipeline
    model, _ = _fit_pipeline(spark, sf)
    users = cut_lineage(read_table(spark, sf, "events").where("user_id is not null").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("user_n"), F.avg("value").alias("user_mean")))

    def scorer(s: DataFrame) -> DataFrame:
        # a user not yet in the table keeps its rows, features defaulted
        feats = s.join(users, "user_id", "left").select(
            "event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("status"),
            F.col("value").cast("double").alias("value"), F.hour("ts").cast("double").alias("hour"),
            F.get_json_object("props", "$.k").try_cast("double").alias("k"),
            F.coalesce("user_n", F.lit(0.0)).alias("user_n"), F.coalesce("user_mean", F.lit(0.0)).alias("user_mean"))
        out = split_probability(model.transform(feats))
        return result_text(out.withColumn("prediction", F.col("prediction").cast("int")), "prediction") \
            .select("event_id", "user_id", "status", "prediction", F.round("p_positive", 6).alias("p_positive"), "result")

    return spark.read.parquet(score_stream(events_stream(spark, sf), scorer, "model-scores"))


QUERIES["stream_model_scores"] = (q_stream_model_scores, None)
