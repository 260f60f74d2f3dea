"""Source / sink round trips and positional reads (IO1-IO13, K3-K5, P21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import project as P
from ..operators import stats as S
from ..operators.ordering import exact_rank, refined_bucket
from ..session import scratch_path
from ..sources import io as IO
from ..sources.tables import longitudinal_orders, read_table
from . import models

LONG_SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("subject", T.LongType()),
                            T.StructField("target", T.DoubleType()), T.StructField("year", T.DoubleType()),
                            T.StructField("month", T.DoubleType()), T.StructField("dow", T.DoubleType()),
                            T.StructField("priority", T.DoubleType()), T.StructField("is_f", T.DoubleType())])


def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """IO6 -> IO1 / IO2: export the longitudinal stand-in as CSV, read it back
    with an explicit schema, and again tolerantly by name."""
    path = scratch_path(spark, "csv")
    IO.write_csv(longitudinal_orders(spark, sf), path)
    typed = IO.read_features(spark, path, LONG_SCHEMA)
    loose = IO.read_longitudinal(spark, path, keep=["o_orderkey", "target"])
    upload = IO.read_upload(spark, path).select("o_orderkey", F.col("is_f").alias("is_f_inferred"))
    return typed.join(loose.withColumnRenamed("target", "target_loose"), "o_orderkey").join(upload, "o_orderkey")


SQL_CSV_ROUNDTRIP = """
SELECT o_orderkey, o_custkey AS subject, o_totalprice AS target, CAST(year(o_orderdate) AS DOUBLE) AS year,
       CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(dayofweek(o_orderdate) + 1 AS DOUBLE) AS dow,
       CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority, CAST(o_orderstatus = 'F' AS DOUBLE) AS is_f,
       o_totalprice AS target_loose, CAST(o_orderstatus = 'F' AS DOUBLE) AS is_f_inferred
FROM orders"""


def q_metrics_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """IO5 -> IO4 -> P21: write the published metrics as JSON, read them back,
    default an absent key."""
    path = scratch_path(spark, "metrics")
    IO.write_metrics(models.published(spark, sf), path)
    m = IO.read_metrics(spark, path)
    return m.select("model_name", "accuracy", "roc_auc", F.col("confusion_matrix")[1][1].alias("tp"),
                    P.metric_or(m, "dataset_size", 195).alias("dataset_size"),
                    P.metric_or(m, "absent_key", 195).alias("absent_default"))


SQL_METRICS_ROUNDTRIP = "WITH m AS (" + models.SQL_PUBLISHED_METRICS + """)
SELECT model_name, accuracy, roc_auc, tp, dataset_size, 195 AS absent_default FROM m"""


def q_log_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """IO11 / IO12 / G24 / K5: append two uploads, tally, clear, tally again."""
    from ..functions.scalar import confidence
    from .explore import scored_log
    rows = scored_log(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "label", "input_type", "result",
                                        "p_positive", confidence(F.lit(1.0) - F.col("p_positive"), F.col("p_positive"))
                                        .alias("confidence"))
    path = scratch_path(spark, "log")
    IO.append_log(rows, path)
    IO.append_log(rows, path)
    log = IO.read_log(spark, path)
    newest = IO.preview(log, 1, [F.col("ts").desc(), F.col("label").desc()])
    full = S.log_tally(log).withColumns({
        "phase": F.lit("after_append"),
        "newest_ts": newest.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).scalar()})
    # the tally is taken before the log is cleared: write it next to the log
    snap = path + "-tally"
    full.write.mode("overwrite").parquet(snap)
    IO.clear_log(spark, path)
    cleared = S.log_tally(IO.read_log(spark, path)).withColumns({
        "phase": F.lit("after_clear"), "newest_ts": F.lit(None).cast("string")})
    return spark.read.parquet(snap).unionByName(cleared)


SQL_LOG_LIFECYCLE = """
SELECT 2 * count(*) AS total, CAST(2 * count_if(value / 613.0 > 0.5) AS BIGINT) AS at_risk,
       CAST(2 * count_if(NOT (value / 613.0 > 0.5)) AS BIGINT) AS healthy, 'after_append' AS phase,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest_ts FROM events
UNION ALL SELECT 0, 0, 0, 'after_clear', NULL"""


def q_preview(spark: SparkSession, sf: str) -> DataFrame:
    """IO13 / K3: first 10 orders by key."""
    return IO.preview(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 10, ["o_orderkey"])


SQL_PREVIEW = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10"


def q_nth_order(spark: SparkSession, sf: str) -> DataFrame:
    """K4: the 3rd order (by date, then key) of every customer, by exact bucketed rank."""
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    days = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    o = refined_bucket(o, ["o_custkey"], days, 365, 1)   # years; a hot year of a customer split into days
    r = exact_rank(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("_vx_rb"), out="pos")
    return r.where(F.col("pos") == 3).select("o_custkey", "o_orderkey", "o_totalprice")


SQL_NTH_ORDER = """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders) WHERE pos = 3"""


QUERIES = {
    "csv_roundtrip": (q_csv_roundtrip, SQL_CSV_ROUNDTRIP),
    "metrics_roundtrip": (q_metrics_roundtrip, SQL_METRICS_ROUNDTRIP),
    "log_lifecycle": (q_log_lifecycle, SQL_LOG_LIFECYCLE),
    "preview": (q_preview, SQL_PREVIEW),
    "nth_order": (q_nth_order, SQL_NTH_ORDER),
}
