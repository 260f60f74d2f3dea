"""Model queries: evaluation with a fixed scorer (SQL-checked), learners,
severity, attributions and the upload analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import explain as X
from ..operators import metrics as M
from ..operators import project as P
from ..operators.sampling import background_sample, split_plain
from ..operators.scoring import metrics_document, severity_linear
from ..sources.tables import EVENT_FEATURES, labelled_events, longitudinal_orders
from .screening import (LABELLED_EVENTS_SQL, LINEAR_BIAS, LINEAR_WEIGHTS, SPLIT_SQL, _scale_sql,
                        linear_score, linear_sql, split_and_scale)

R6 = lambda c: F.round(F.col(c), 6).alias(c)
HOLDOUT_SQL = "WITH " + LABELLED_EVENTS_SQL + ",\n" + SPLIT_SQL + ",\n" + _scale_sql(EVENT_FEATURES) + ",\n" + linear_sql()


def scored_holdout(spark: SparkSession, sf: str) -> DataFrame:
    z, _ = split_and_scale(spark, sf)
    return linear_score(z)


# --- G17 / G19 / P19 / P20 / M14 ---------------------------------------------

def q_confusion_matrix(spark, sf):
    return M.confusion(scored_holdout(spark, sf), "status", "prediction")


SQL_CONFUSION_MATRIX = HOLDOUT_SQL + """
SELECT a.actual, CAST(count_if(s.prediction = 0) AS BIGINT) AS pred_0, CAST(count_if(s.prediction = 1) AS BIGINT) AS pred_1
FROM (VALUES (0), (1)) a(actual) LEFT JOIN scored s ON s.status = a.actual GROUP BY a.actual"""


def q_class_report(spark, sf):
    r = M.class_report(scored_holdout(spark, sf), "status", "prediction")
    return r.select("class", R6("precision"), R6("recall"), R6("f1"), "support")


SQL_CLASS_REPORT = HOLDOUT_SQL + """,
c AS (SELECT CAST(count_if(status = 1 AND prediction = 1) AS DOUBLE) tp, CAST(count_if(status = 0 AND prediction = 1) AS DOUBLE) fp,
             CAST(count_if(status = 1 AND prediction = 0) AS DOUBLE) fn, CAST(count_if(status = 0 AND prediction = 0) AS DOUBLE) tn FROM scored),
per AS (SELECT '0' AS class, CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS precision,
               CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS recall,
               CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f1, CAST(tn + fp AS BIGINT) AS support FROM c
        UNION ALL
        SELECT '1', CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END,
               CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, CAST(tp + fn AS BIGINT) FROM c),
allr AS (SELECT * FROM per
         UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
         UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                          sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM allr"""


def published(spark, sf):
    """Fixed scorer evaluated on the whole labelled set (as the published report does)."""
    df = labelled_events(spark, sf)
    from ..operators.learn import standardise
    z, _, _ = standardise(df, None, EVENT_FEATURES)
    s = linear_score(z)
    return metrics_document(s, "status", "LinearScorer", "Fixed linear scorer", df.count(), "events stand-in",
                            len(EVENT_FEATURES), score_col="score")


def q_published_metrics(spark, sf):
    d = published(spark, sf)
    return d.select("model_name", "accuracy", "precision", "recall", "f1", "roc_auc",
                    F.col("confusion_matrix")[0][0].alias("tn"), F.col("confusion_matrix")[0][1].alias("fp"),
                    F.col("confusion_matrix")[1][0].alias("fn"), F.col("confusion_matrix")[1][1].alias("tp"),
                    "n_features", "cv_folds", "dataset_size")


def _full_scored_sql() -> str:
    aggs, zs = [], []
    for f in EVENT_FEATURES:
        aggs.append(f"avg({f}) AS mu_{f}")
        aggs.append(f"CASE WHEN stddev_pop({f}) = 0 OR stddev_pop({f}) IS NULL THEN 1.0 ELSE stddev_pop({f}) END AS sd_{f}")
        zs.append(f"(s.{f} - p.mu_{f}) / p.sd_{f} AS {f}")
    return ("WITH " + LABELLED_EVENTS_SQL + f",\nparams AS (SELECT {', '.join(aggs)} FROM labelled),\n"
            f"z AS (SELECT s.status, s.event_id, {', '.join(zs)} FROM labelled s, params p),\n" + linear_sql())


SQL_PUBLISHED_METRICS = _full_scored_sql() + """,
c AS (SELECT count(*) n, count_if(status = 1 AND prediction = 1) tp, count_if(status = 0 AND prediction = 1) fp,
             count_if(status = 1 AND prediction = 0) fn, count_if(status = 0 AND prediction = 0) tn FROM scored),
sc AS (SELECT score, count_if(status = 1) AS pos, count_if(status = 0) AS neg FROM scored GROUP BY score),
cum AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM sc),
auc AS (SELECT CAST(sum(pos * (neg_le - neg * 0.5)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM cum)
SELECT 'LinearScorer' AS model_name,
       round((tp + tn) / CAST(n AS DOUBLE), 4) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 4) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 4) AS f1,
       round(auc, 4) AS roc_auc, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tp AS BIGINT) AS tp, 5 AS n_features, 5 AS cv_folds, n AS dataset_size
FROM c, auc"""


def q_metrics_long(spark, sf):
    d = published(spark, sf)
    return P.metrics_long(d.select("model_name", "accuracy", "precision", "recall", "f1", "roc_auc"),
                          ["model_name"], ["accuracy", "precision", "recall", "f1", "roc_auc"]) \
        .withColumn("score", F.round(F.col("score") * 100.0, 2))


SQL_METRICS_LONG = "WITH m AS (" + SQL_PUBLISHED_METRICS.replace("\n", "\n  ") + """)
SELECT model_name, metric, round(score * 100.0, 2) AS score FROM (
  SELECT model_name, 'accuracy' AS metric, accuracy AS score FROM m UNION ALL
  SELECT model_name, 'precision', precision FROM m UNION ALL SELECT model_name, 'recall', recall FROM m UNION ALL
  SELECT model_name, 'f1', f1 FROM m UNION ALL SELECT model_name, 'roc_auc', roc_auc FROM m)"""


def q_confusion_frame(spark, sf):
    return P.confusion_frame(published(spark, sf), "confusion_matrix")


SQL_CONFUSION_FRAME = "WITH m AS (" + SQL_PUBLISHED_METRICS + """)
SELECT 'Healthy' AS actual, tn AS predicted_healthy, fp AS predicted_positive FROM m
UNION ALL SELECT 'Parkinson''s', fn, tp FROM m"""


# --- G21: regression metrics with a fixed predictor ----------------------------

def q_regression_metrics(spark, sf):
    o = split_plain(longitudinal_orders(spark, sf), "o_orderkey")
    pri = o.where(~F.col("is_test")).groupBy("priority").agg(F.avg("target").alias("yhat"))
    te = o.where(F.col("is_test")).join(pri, "priority")
    r = M.regression_metrics(te, "target", "yhat")
    return r.select("n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


SQL_REGRESSION_METRICS = """
WITH h AS (SELECT o_orderkey, o_totalprice AS target, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
                  md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))) AS h FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS rk, count(*) OVER () AS n FROM h),
s AS (SELECT *, rk <= round(0.2 * n) AS is_test FROM r),
pri AS (SELECT priority, avg(target) AS yhat FROM s WHERE NOT is_test GROUP BY 1),
te AS (SELECT s.target, p.yhat FROM s JOIN pri p USING (priority) WHERE is_test)
SELECT count(*) AS n, round(avg(abs(yhat - target)), 4) AS mae, round(sqrt(avg((yhat - target) * (yhat - target))), 4) AS rmse,
       round(1.0 - sum((yhat - target) * (yhat - target)) / (var_pop(target) * count(target)), 6) AS r2 FROM te"""


# --- M13 / J2 / X13: severity with a fixed linear regressor -------------------------

SEV_COEF = {"value": 12.0, "user_mean": 3.0, "hour": 0.5}
SEV_INTERCEPT = 30.0


def q_severity_scores(spark, sf):
    s = severity_linear(scored_holdout(spark, sf), SEV_COEF, SEV_INTERCEPT)
    return s.select("event_id", R6("severity"), "severity_band", "severity_color", "severity_margin")


SQL_SEVERITY_SCORES = HOLDOUT_SQL + """,
sv AS (SELECT event_id, greatest(0.0, least(59.0, """ + str(SEV_INTERCEPT) + " + " + " + ".join(
    f"{w} * {f}" for f, w in SEV_COEF.items()) + """)) AS severity FROM scored WHERE prediction = 1)
SELECT event_id, round(severity, 6) AS severity,
       CASE WHEN round_even(severity, 0) BETWEEN 0 AND 10 THEN 'None / Minimal'
            WHEN round_even(severity, 0) BETWEEN 11 AND 30 THEN 'Mild'
            WHEN round_even(severity, 0) BETWEEN 31 AND 58 THEN 'Moderate' ELSE 'Severe' END AS severity_band,
       CASE WHEN round_even(severity, 0) BETWEEN 0 AND 10 THEN '#27AE60'
            WHEN round_even(severity, 0) BETWEEN 11 AND 30 THEN '#F39C12'
            WHEN round_even(severity, 0) BETWEEN 31 AND 58 THEN '#E67E22' ELSE '#E74C3C' END AS severity_color,
       CAST(5.2 AS DOUBLE) AS severity_margin
FROM sv"""


# --- M17 / X11 / W10 / K2 / M18 / U5: attributions ----------------------------------

def _background_means(spark, sf):
    df = labelled_events(spark, sf)
    from ..operators.sampling import split_stratified
    from ..operators.stats import fit_scaler
    from ..operators.joins import apply_scaler
    s = split_stratified(df, "event_id", "status")
    params = fit_scaler(s.where(~F.col("is_test")), EVENT_FEATURES)
    train_z = apply_scaler(s.where(~F.col("is_test")), params, EVENT_FEATURES)
    bg = background_sample(train_z, "event_id", C.BACKGROUND_ROWS)
    return bg


def q_linear_attribution(spark, sf):
    z = scored_holdout(spark, sf)
    bg = _background_means(spark, sf)
    means = bg.agg(*[F.avg(f).alias(f) for f in EVENT_FEATURES]).first().asDict()
    att = X.linear_attribution(z, "event_id", LINEAR_WEIGHTS, means)
    top = X.rank_abs(att, "event_id", C.TOP_ATTRIBUTION)
    return top.select("event_id", "feature", R6("value"), "direction", F.col("rank").cast("long"))


def _attr_sql(value_expr: str) -> str:
    return HOLDOUT_SQL + """,
bgz AS (SELECT * FROM (
          SELECT s.event_id, """ + ", ".join(f"(s.{f} - p.mu_{f}) / p.sd_{f} AS {f}" for f in EVENT_FEATURES) + """
          FROM split s, params p WHERE NOT s.is_test)
        ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))), event_id LIMIT 50),
bm AS (SELECT """ + ", ".join(f"avg({f}) AS m_{f}" for f in EVENT_FEATURES) + """ FROM bgz),
att AS (""" + "\nUNION ALL ".join(
        f"SELECT event_id, {i} AS feature_idx, '{f}' AS feature, {w} * ({f} - m_{f}) AS value FROM scored, bm"
        for i, (f, w) in enumerate(LINEAR_WEIGHTS.items())) + """),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, feature_idx) AS rank FROM att)
SELECT event_id, feature, round(value, 6) AS value,
       CASE WHEN value > 0 THEN 'toward Parkinson''s' ELSE 'toward Healthy' END AS direction, rank
FROM rk WHERE rank <= 14"""


SQL_LINEAR_ATTRIBUTION = _attr_sql("value")


def q_sampling_shapley(spark, sf):
    """M18 on the fixed linear margin: equals the exact linear attribution."""
    z = scored_holdout(spark, sf).select("event_id", *EVENT_FEATURES)
    bg = _background_means(spark, sf)

    def predict(h):
        m = F.lit(LINEAR_BIAS)
        for f, w in LINEAR_WEIGHTS.items():
            m = m + F.lit(w) * F.col(f)
        return h.withColumn("fx", m)
    sv = X.sampling_shapley(z, "event_id", bg, EVENT_FEATURES, predict, n_perm=4)
    return sv.select("event_id", "feature", F.round("value", 6).alias("value"))


SQL_SAMPLING_SHAPLEY = SQL_LINEAR_ATTRIBUTION.rsplit("rk AS", 1)[0].rstrip().rstrip(",") + \
    "\nSELECT event_id, feature, round(value, 6) AS value FROM att"


QUERIES = {
    "confusion_matrix": (q_confusion_matrix, SQL_CONFUSION_MATRIX),
    "class_report": (q_class_report, SQL_CLASS_REPORT),
    "published_metrics": (q_published_metrics, SQL_PUBLISHED_METRICS),
    "metrics_long": (q_metrics_long, SQL_METRICS_LONG),
    "confusion_frame": (q_confusion_frame, SQL_CONFUSION_FRAME),
    "regression_metrics": (q_regression_metrics, SQL_REGRESSION_METRICS),
    "severity_scores": (q_severity_scores, SQL_SEVERITY_SCORES),
    "linear_attribution": (q_linear_attribution, SQL_LINEAR_ATTRIBUTION),
    "sampling_shapley": (q_sampling_shapley, SQL_SAMPLING_SHAPLEY),
}
