"""Hold-out screening on the labelled stand-in (the flagship query).

events -> label -> exact stratified split -> scaler fitted on the training
rows -> standardise the test rows -> fixed linear score -> confusion counts,
accuracy, precision, recall, F1 and exact AUC in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid
from ..operators.joins import apply_scaler
from ..operators.metrics import binary_report
from ..operators.sampling import split_stratified
from ..operators.stats import fit_scaler
from ..session import cut_lineage
from ..sources.tables import EVENT_FEATURES, labelled_events

# Fixed coefficients of the demonstration scorer (on standardised features).
LINEAR_WEIGHTS = {"value": 0.8, "hour": 0.1, "k": 0.05, "user_n": 0.3, "user_mean": -0.2}
LINEAR_BIAS = -1.0


def linear_score(df: DataFrame, weights=LINEAR_WEIGHTS, bias=LINEAR_BIAS) -> DataFrame:
    m = F.lit(bias)
    for f, w in weights.items():
        m = m + F.lit(w) * F.col(f)
    return df.withColumns({"margin": m}).withColumns({
        "score": sigmoid(F.col("margin"))}).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def split_and_scale(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # the split is read by the scaler fit and by the scoring: written once to
    # the shared folder (the fit / transform boundary)
    df = cut_lineage(split_stratified(labelled_events(spark, sf_dir), "event_id", "status"))
    train = df.where(~F.col("is_test"))
    test = df.where(F.col("is_test"))
    params = fit_scaler(train, EVENT_FEATURES)
    return apply_scaler(test, params, EVENT_FEATURES), params


def holdout_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, _ = split_and_scale(spark, sf_dir)
    rep = binary_report(linear_score(z), "status", "prediction", "score")
    return rep.select("n", "tp", "fp", "fn", "tn",
                      *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


# --- SQL oracle --------------------------------------------------------------

LABELLED_EVENTS_SQL = """
labelled AS (
  SELECT e.event_id, e.user_id,
         CAST(e.event_type = 'purchase' AS INTEGER) AS status,
         CAST(e.value AS DOUBLE) AS value,
         CAST(hour(e.ts) AS DOUBLE) AS hour,
         CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS k,
         CAST(u.user_n AS DOUBLE) AS user_n,
         CAST(u.user_mean AS DOUBLE) AS user_mean
  FROM events e JOIN (SELECT user_id, count(*) AS user_n, avg(value) AS user_mean
                      FROM events GROUP BY user_id) u USING (user_id)
)"""

SPLIT_SQL = """
hashed AS (SELECT *, md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))) AS h FROM labelled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY h, event_id) AS rk,
                  count(*) OVER (PARTITION BY status) AS nc FROM hashed),
split AS (SELECT *, rk <= round(0.2 * nc) AS is_test FROM ranked)"""

SCALE_SQL = """
params AS (
  SELECT {aggs} FROM split WHERE NOT is_test
),
z AS (
  SELECT s.status, s.event_id, {zs} FROM split s, params p WHERE s.is_test
)"""


def _scale_sql(feats):
    aggs = []
    zs = []
    for f in feats:
        aggs.append(f"avg({f}) AS mu_{f}")
        aggs.append(f"CASE WHEN stddev_pop({f}) = 0 OR stddev_pop({f}) IS NULL THEN 1.0 ELSE stddev_pop({f}) END AS sd_{f}")
        zs.append(f"(s.{f} - p.mu_{f}) / p.sd_{f} AS {f}")
    return SCALE_SQL.format(aggs=", ".join(aggs), zs=", ".join(zs))


def linear_sql(src: str = "z") -> str:
    m = f"{LINEAR_BIAS}"
    for f, w in LINEAR_WEIGHTS.items():
        m += f" + {w} * {f}"
    return f"""scored AS (
  SELECT *, 1.0 / (1.0 + exp(-({m}))) AS score,
         CAST(1.0 / (1.0 + exp(-({m}))) >= 0.5 AS INTEGER) AS prediction FROM {src}
)"""


REPORT_SQL = """
counts AS (
  SELECT count(*) AS n,
         CAST(count_if(status = 1 AND prediction = 1) AS BIGINT) AS tp,
         CAST(count_if(status = 0 AND prediction = 1) AS BIGINT) AS fp,
         CAST(count_if(status = 1 AND prediction = 0) AS BIGINT) AS fn,
         CAST(count_if(status = 0 AND prediction = 0) AS BIGINT) AS tn
  FROM scored
),
sc AS (SELECT score, count_if(status = 1) AS pos, count_if(status = 0) AS neg FROM scored GROUP BY score),
cum AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM sc),
auc AS (
  SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0
              THEN CAST(sum(pos * (neg_le - neg * 0.5)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
  FROM cum
)
SELECT n, tp, fp, fn, tn,
       round(CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / CAST(n AS DOUBLE) END, 6) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1,
       round(auc, 6) AS auc
FROM counts, auc"""


def holdout_screening_sql() -> str:
    return ("WITH " + LABELLED_EVENTS_SQL + ",\n" + SPLIT_SQL + ",\n" + _scale_sql(EVENT_FEATURES)
            + ",\n" + linear_sql() + ",\n" + REPORT_SQL)
