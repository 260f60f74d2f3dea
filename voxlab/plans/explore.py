"""Exploration, projection, band and split queries over the test tables.

Each ``q_*`` function has a matching ``SQL_*`` string for the DuckDB oracle.
Floats are rounded in both (6 digits; 4 for large magnitudes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalar import (band_case, clip, risk_tier, safe_number, to_percent, complement, confidence,
                                target_size)
from ..operators import metrics as M
from ..operators import project as P
from ..operators import stats as S
from ..operators.joins import band_join
from ..operators.ordering import refined_bucket
from ..operators.sampling import assign_folds, background_sample, split_plain
from ..sources.tables import labelled_events, longitudinal_orders, read_table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _acct_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", (F.col("c_acctbal") + F.lit(1000.0)) * F.lit(108.0) / F.lit(11000.0))


# --- J2 / J1: band range joins ------------------------------------------------

def q_band_serving(spark: SparkSession, sf: str) -> DataFrame:
    c = _acct_score(read_table(spark, sf, "customer").select("c_custkey", "c_acctbal"))
    b = band_join(c, "score", rounding="half_even")
    return b.select("c_custkey", F.round("score", 6).alias("score"), "band", "band_color")


def q_band_training(spark: SparkSession, sf: str) -> DataFrame:
    c = _acct_score(read_table(spark, sf, "customer").select("c_custkey", "c_acctbal"))
    b = band_join(c, "score", rounding=None)
    return b.select("c_custkey", F.round("score", 6).alias("score"), "band", "band_color")


_BANDS_VALUES = ", ".join(f"({lo}, {hi}, '{lab}', '{col}')" for lo, hi, lab, col, _, _ in C.SEVERITY_BANDS)


def _band_sql(rounded: bool) -> str:
    s = "round_even(score, 0)" if rounded else "score"
    return f"""
WITH c AS (SELECT c_custkey, (c_acctbal + 1000.0) * 108.0 / 11000.0 AS score FROM customer),
bands(lo, hi, label, color) AS (VALUES {_BANDS_VALUES})
SELECT c_custkey, round(score, 6) AS score, coalesce(b.label, 'Severe') AS band,
       coalesce(b.color, '#E74C3C') AS band_color
FROM c LEFT JOIN bands b ON {s} >= b.lo AND {s} <= b.hi"""


SQL_BAND_SERVING = _band_sql(True)
SQL_BAND_TRAINING = _band_sql(False)


# --- X2/X4/X7/X10/X13/X14/K7: scalar functions on scored rows -----------------

def q_risk_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: probability from price share, percent, tier, formats, severity clip and band."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    p = o.withColumn("p", F.col("o_totalprice") / F.lit(531441.0))
    return p.select(
        "o_orderkey",
        F.round("p", 6).alias("p_positive"),
        F.round(complement("p"), 6).alias("p_healthy"),
        F.round(confidence(complement("p"), F.col("p")), 6).alias("confidence"),
        risk_tier(to_percent("p")).alias("tier"),
        F.round(clip(F.col("p") * 108.0, 0.0, 59.0), 6).alias("severity"),
        band_case(clip(F.col("p") * 108.0, 0.0, 59.0), "half_even").alias("band"),
        F.bround(F.col("p") * 108.0, 0).alias("severity_even"),
        (F.col("p") * 1000 > 500).alias("flag"),
    )


SQL_RISK_SCALARS = """
WITH p AS (SELECT o_orderkey, o_totalprice / 531441.0 AS p FROM orders),
q AS (SELECT *, greatest(0.0, least(59.0, p * 108.0)) AS sev FROM p)
SELECT o_orderkey, round(p, 6) AS p_positive, round(1.0 - p, 6) AS p_healthy,
       round(greatest(1.0 - p, p), 6) AS confidence,
       CASE WHEN p * 100.0 >= 60 THEN 'red' WHEN p * 100.0 >= 40 THEN 'amber' ELSE 'green' END AS tier,
       round(sev, 6) AS severity,
       CASE WHEN round_even(sev, 0) BETWEEN 0 AND 10 THEN 'None / Minimal'
            WHEN round_even(sev, 0) BETWEEN 11 AND 30 THEN 'Mild'
            WHEN round_even(sev, 0) BETWEEN 31 AND 58 THEN 'Moderate'
            WHEN round_even(sev, 0) BETWEEN 59 AND 200 THEN 'Severe' ELSE 'Severe' END AS band,
       round_even(p * 108.0, 0) AS severity_even,
       p * 1000 > 500 AS flag
FROM q"""


# --- F4: guarded numbers -------------------------------------------------------

def q_safe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_id", "props", "event_type", "value")
    return e.select("event_id",
                    safe_number(F.get_json_object("props", "$.k")).alias("k"),
                    safe_number("event_type").alias("type_num"),
                    safe_number(F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))).alias("v"))


SQL_SAFE_NUMBERS = """
SELECT event_id,
       coalesce(CASE WHEN isnan(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) THEN 0.0
                     ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END, 0.0) + 0.0 AS k,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) + 0.0 AS type_num,
       CASE WHEN value > 100 THEN 0.0 ELSE coalesce(value, 0.0) END + 0.0 AS v
FROM events"""


# --- G1/G2/G26/U1/P1/P7: union of two sets, totals ------------------------------

def union_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled stand-in (events) and all-positive longitudinal stand-in
    (orders) harmonised to common names and unioned by name."""
    ev = labelled_events(spark, sf).select(F.col("event_id").alias("row_key"), "status", "value", "hour")
    ev = P.with_constant(ev, "source", "labelled")
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_key"), (F.col("o_totalprice") / 1000.0).alias("price_k"),
        F.month("o_orderdate").cast("double").alias("month"))
    o = P.harmonise(o, {"price_k": "value", "month": "hour", "absent_column": "ignored"})
    o = P.with_constant(P.with_constant(o, "status", 1), "source", "longitudinal")
    return ev.unionByName(o)


def q_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    u = union_sets(spark, sf)
    return S.dataset_summary(u, "status", n_features=2)


SQL_UNION = """
u AS (
  SELECT event_id AS row_key, CAST(event_type = 'purchase' AS INTEGER) AS status, value,
         CAST(hour(ts) AS DOUBLE) AS hour, 'labelled' AS source FROM events
  UNION ALL
  SELECT o_orderkey, 1, o_totalprice / 1000.0, CAST(month(o_orderdate) AS DOUBLE), 'longitudinal' FROM orders
)"""

SQL_DATASET_SUMMARY = "WITH " + SQL_UNION + """
SELECT count(*) AS samples, CAST(count_if(status = 1) AS BIGINT) AS positives,
       CAST(count_if(status = 0) AS BIGINT) AS healthy, 2 AS features FROM u"""


def q_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    """G3 on the union: rows per source x class with the zero cell kept."""
    return S.class_balance(union_sets(spark, sf), "source", "status")


SQL_CLASS_BALANCE = "WITH " + SQL_UNION + """
SELECT source, CAST(count_if(status = 1) AS BIGINT) AS n_positive,
       CAST(count_if(status = 0) AS BIGINT) AS n_negative FROM u GROUP BY source"""


def q_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.label_counts(labelled_events(spark, sf), "status")


SQL_LABEL_COUNTS = """
SELECT count(*) AS n, CAST(count_if(event_type = 'purchase') AS BIGINT) AS n_positive,
       CAST(count_if(event_type <> 'purchase') AS BIGINT) AS n_negative FROM events"""


def q_subject_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct subjects and target range of the longitudinal stand-in."""
    o = longitudinal_orders(spark, sf)
    return o.agg(S.nunique("subject").alias("n_subjects"), *S.value_range("target"), S.row_count().alias("n_rows"))


SQL_SUBJECT_SUMMARY = """
SELECT count(DISTINCT o_custkey) AS n_subjects, min(o_totalprice) AS min_value,
       max(o_totalprice) AS max_value, count(*) AS n_rows FROM orders"""


# --- G7: exact percentiles --------------------------------------------------------

PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def q_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    q = S.percentiles(li, "l_extendedprice", PROBS, by=["l_returnflag"])
    return q.select("l_returnflag", "p", F.round("value", 4).alias("value"))


SQL_PERCENTILES = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS p, round(quantile_cont(l_extendedprice, {p}), 4) AS value FROM lineitem GROUP BY l_returnflag"
    for p in PROBS) + ")"


# --- G16: correlation matrix ------------------------------------------------------

def _lineitem_labelled(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(*MEASURES, (F.col("l_returnflag") == "R").cast("int").alias("status"))


def q_corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return S.corr_matrix(_lineitem_labelled(spark, sf), MEASURES + ["status"], digits=2)


def _corr_sql():
    cols = MEASURES + ["status"]
    parts = []
    for a in cols:
        for b in cols:
            v = "1.0" if a == b else f"round(corr({a}, {b}), 2)"
            parts.append(f"SELECT '{a}' AS row_feature, '{b}' AS col_feature, {v} AS r"
                         + ("" if a == b else " FROM li"))
    return ("WITH li AS (SELECT " + ", ".join(MEASURES) +
            ", CAST(l_returnflag = 'R' AS INTEGER) AS status FROM lineitem)\n" + "\nUNION ALL\n".join(parts))


SQL_CORR_MATRIX = _corr_sql()


# --- G22: scaler fit ------------------------------------------------------------------

def q_scaler_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = S.fit_scaler(_lineitem_labelled(spark, sf), MEASURES)
    return p.select(*[F.round(c, 4).alias(c) for c in p.columns])


SQL_SCALER_FIT = "SELECT " + ", ".join(
    f"round(avg({m}), 4) AS mu_{m}, round(CASE WHEN stddev_pop({m}) = 0 THEN 1.0 ELSE stddev_pop({m}) END, 4) AS sd_{m}"
    for m in MEASURES) + " FROM lineitem"


# --- G23: violin summary ---------------------------------------------------------------

def q_violin_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = S.violin_summary(_lineitem_labelled(spark, sf), MEASURES, "status")
    return v.select("feature", "class", "n", *[F.round(c, 4).alias(c) for c in ("mean", "min", "q1", "median", "q3", "max")])


SQL_VIOLIN_SUMMARY = "WITH li AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS class FROM lineitem)\n" + \
    "\nUNION ALL\n".join(
        f"SELECT '{m}' AS feature, class, count({m}) AS n, round(avg({m}), 4) AS mean, round(min({m}), 4) AS min, "
        f"round(quantile_cont({m}, 0.25), 4) AS q1, round(quantile_cont({m}, 0.5), 4) AS median, "
        f"round(quantile_cont({m}, 0.75), 4) AS q3, round(max({m}), 4) AS max FROM li GROUP BY class"
        for m in MEASURES)


# --- U3 / W9 / U5: splits, folds, background sample ---------------------------------------

def q_split_plain(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return split_plain(o, "o_orderkey").select("o_orderkey", "is_test")


SQL_SPLIT_PLAIN = """
WITH h AS (SELECT o_orderkey, md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))) AS h FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS rk, count(*) OVER () AS n FROM h)
SELECT o_orderkey, rk <= round(0.2 * n) AS is_test FROM r"""


def q_split_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = split_plain(o, "o_orderkey", group_col="o_custkey")
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_subjects"),
                                    F.sum("o_orderkey").alias("key_sum"))


SQL_SPLIT_BY_SUBJECT = """
WITH g AS (SELECT DISTINCT o_custkey FROM orders),
h AS (SELECT o_custkey, md5(concat_ws('|', '42', CAST(o_custkey AS VARCHAR))) AS h FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY h, o_custkey) AS rk, count(*) OVER () AS n FROM h),
t AS (SELECT o_custkey, rk <= round(0.2 * n) AS is_test FROM r)
SELECT is_test, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_subjects, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders JOIN t USING (o_custkey) GROUP BY is_test"""


def q_stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    ev = labelled_events(spark, sf).select("event_id", "status")
    return assign_folds(ev, "event_id", "status").select("event_id", "status", "fold")


SQL_STRATIFIED_FOLDS = """
WITH h AS (SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS status,
                  md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))) AS h FROM events)
SELECT event_id, status, CAST((row_number() OVER (PARTITION BY status ORDER BY h, event_id) - 1) % 5 AS INTEGER) AS fold FROM h"""


def q_background_sample(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    return background_sample(ev, "event_id", 50)


SQL_BACKGROUND_SAMPLE = """
SELECT event_id, user_id, value FROM events
ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))), event_id LIMIT 50"""


# --- W6: average rank -----------------------------------------------------------------------

def q_average_rank(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return M.average_rank(li, "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity", "avg_rank")


SQL_AVERAGE_RANK = """
WITH c AS (SELECT l_quantity AS s, count(*) AS c FROM lineitem GROUP BY 1),
r AS (SELECT s, CAST(sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS DOUBLE) + (c + 1) / 2.0 AS avg_rank FROM c)
SELECT l_orderkey, l_linenumber, l_quantity, avg_rank FROM lineitem JOIN r ON l_quantity = r.s"""


# --- P14/P15/P16/G24/X9/P8: typed prediction log, its view and tally ------------------------------

def scored_log(spark: SparkSession, sf: str) -> DataFrame:
    """Typed log rows from a deterministic score on events (one 'upload' per user)."""
    e = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    p = e.withColumn("p_positive", F.col("value") / F.lit(613.0))
    p = p.withColumn("prediction", (F.col("p_positive") > 0.5).cast("int"))
    p = P.result_text(p, "prediction")
    # hour buckets, hot hours of a user split into milliseconds
    p = refined_bucket(p, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000, 1_000)
    p = P.row_labels(p, "Sample", ["ts", "event_id"], by=["user_id"], out="label", bucket=F.col("_vx_rb"))
    return p.drop("_vx_rb")


def q_prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    p = P.format_log(scored_log(spark, sf), ts="ts", p1="p_positive")
    p = P.map_values(p, "prediction", C.CLASS_NAMES, "diagnosis")
    return p.select("event_id", "label", "result", "input_type", "diagnosis", "time_text", "p_text",
                    "confidence_text", "delta_positive", "delta_healthy")


SQL_PREDICTION_LOG = """
WITH p AS (SELECT event_id, user_id, ts, value / 613.0 AS p FROM events)
SELECT event_id,
       'Sample ' || CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR) AS label,
       CASE WHEN p > 0.5 THEN 'Parkinson''s Risk' ELSE 'Healthy' END AS result,
       'CSV' AS input_type,
       CASE WHEN p > 0.5 THEN 'Parkinson''s' ELSE 'Healthy' END AS diagnosis,
       strftime(ts, '%H:%M:%S') AS time_text,
       printf('%.1f%%', p * 100.0) AS p_text,
       printf('%.1f%%', greatest(1.0 - p, p) * 100.0) AS confidence_text,
       CASE WHEN p > 0.5 THEN printf('%+.1fpp', (p - 0.5) * 100.0) END AS delta_positive,
       CASE WHEN 1.0 - p > 0.5 THEN printf('%+.1fpp', ((1.0 - p) - 0.5) * 100.0) END AS delta_healthy
FROM p"""


def q_log_tally(spark: SparkSession, sf: str) -> DataFrame:
    return S.log_tally(scored_log(spark, sf), "result", C.RESULT_POSITIVE)


SQL_LOG_TALLY = """
SELECT count(*) AS total, CAST(count_if(value / 613.0 > 0.5) AS BIGINT) AS at_risk,
       CAST(count_if(NOT (value / 613.0 > 0.5)) AS BIGINT) AS healthy FROM events"""


# --- F5: input contract --------------------------------------------------------------------------

def q_validate_input(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    v = P.validate_input(li, MEASURES + ["l_returnflag", "absent_feature"])
    return v.select("n_rows", F.array_join("absent_features", ",").alias("absent"),
                    F.array_join("non_numeric_features", ",").alias("non_numeric"),
                    *[F.col("missing_values")[m].alias(f"missing_{m}") for m in MEASURES])


SQL_VALIDATE_INPUT = "SELECT count(*) AS n_rows, 'absent_feature' AS absent, 'l_returnflag' AS non_numeric, " + \
    ", ".join(f"CAST(count_if({m} IS NULL OR isnan({m})) AS BIGINT) AS missing_{m}" for m in MEASURES) + " FROM lineitem"


# --- X12: oversample target size -----------------------------------------------------------------

def q_oversample_target(spark: SparkSession, sf: str) -> DataFrame:
    c = S.label_counts(labelled_events(spark, sf), "status")
    return c.select("n_positive", "n_negative", target_size(F.col("n_negative")).alias("target"),
                    F.greatest(target_size(F.col("n_negative")) - F.col("n_positive"), F.lit(0)).alias("n_synthetic"))


SQL_OVERSAMPLE_TARGET = """
WITH c AS (SELECT CAST(count_if(event_type = 'purchase') AS BIGINT) AS n_positive,
                  CAST(count_if(event_type <> 'purchase') AS BIGINT) AS n_negative FROM events)
SELECT n_positive, n_negative, CAST(floor(n_negative * 0.25) AS BIGINT) AS target,
       greatest(CAST(floor(n_negative * 0.25) AS BIGINT) - n_positive, 0) AS n_synthetic FROM c"""


QUERIES = {
    "band_serving": (q_band_serving, SQL_BAND_SERVING),
    "band_training": (q_band_training, SQL_BAND_TRAINING),
    "risk_scalars": (q_risk_scalars, SQL_RISK_SCALARS),
    "safe_numbers": (q_safe_numbers, SQL_SAFE_NUMBERS),
    "dataset_summary": (q_dataset_summary, SQL_DATASET_SUMMARY),
    "class_balance": (q_class_balance, SQL_CLASS_BALANCE),
    "label_counts": (q_label_counts, SQL_LABEL_COUNTS),
    "subject_summary": (q_subject_summary, SQL_SUBJECT_SUMMARY),
    "percentiles": (q_percentiles, SQL_PERCENTILES),
    "corr_matrix": (q_corr_matrix, SQL_CORR_MATRIX),
    "scaler_fit": (q_scaler_fit, SQL_SCALER_FIT),
    "violin_summary": (q_violin_summary, SQL_VIOLIN_SUMMARY),
    "split_plain": (q_split_plain, SQL_SPLIT_PLAIN),
    "split_by_subject": (q_split_by_subject, SQL_SPLIT_BY_SUBJECT),
    "stratified_folds": (q_stratified_folds, SQL_STRATIFIED_FOLDS),
    "background_sample": (q_background_sample, SQL_BACKGROUND_SAMPLE),
    "average_rank": (q_average_rank, SQL_AVERAGE_RANK),
    "prediction_log": (q_prediction_log, SQL_PREDICTION_LOG),
    "log_tally": (q_log_tally, SQL_LOG_TALLY),
    "validate_input": (q_validate_input, SQL_VALIDATE_INPUT),
    "oversample_target": (q_oversample_target, SQL_OVERSAMPLE_TARGET),
}


# --- F1 / F3 / P2 / P4 / P5 / P6 / P9 / P11 / P17: projections and class filters ----

def q_class_view(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric columns minus an exclusion set, ordered intersection with a
    wanted list, optional and strict drops, class filter, positive filter,
    casts, and the feature values in long form."""
    li = read_table(spark, sf, "lineitem")
    li = li.withColumn("status", (F.col("l_returnflag") == "R").cast("int"))
    li = P.drop_if_present(li, ["absent_col", "l_comment"])
    li = P.drop_strict(li, ["l_linestatus"])
    num = P.numeric_columns(li, exclude=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "status"])
    feats = P.common_columns(li, ["l_tax", "absent_feature"] + [c for c in num if c != "l_tax"])
    sel = P.class_filter(li, "status", 1, ["l_orderkey", "l_linenumber"] + feats)
    sel = P.positive(sel, "l_discount")
    sel = P.cast_columns(sel, {"l_linenumber": "long"})
    arr = sel.select("l_orderkey", "l_linenumber", F.array(*[F.col(f) for f in feats]).alias("vals"))
    return P.explode_named(arr, "vals", feats, keep=["l_orderkey", "l_linenumber"]) \
        .select("l_orderkey", "l_linenumber", "feature", F.round("value", 6).alias("value"))


SQL_CLASS_VIEW = """
WITH s AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, feature, round(value, 6) AS value FROM (
  SELECT l_orderkey, l_linenumber, 'l_tax' AS feature, l_tax AS value FROM s UNION ALL
  SELECT l_orderkey, l_linenumber, 'l_quantity', l_quantity FROM s UNION ALL
  SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM s UNION ALL
  SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM s)"""

QUERIES["class_view"] = (q_class_view, SQL_CLASS_VIEW)
