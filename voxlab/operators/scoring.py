"""Scoring: batch (M11), single record (M12), severity (M13), published
metrics (M14) and the upload analysis composition (M20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalar import clip_severity, confidence
from .joins import band_join
from .metrics import binary_report
from .project import fill_absent, positives_only, select_if_complete, split_probability


def score(df: DataFrame, model, feats: Sequence[str], prob: bool = True) -> DataFrame:
    """Class and probabilities for every row (one lazy transform).

    ``model`` is a fitted Spark model (or PipelineModel) reading
    ``features``.  Adds ``prediction`` (int), ``p_healthy``, ``p_positive``
    and ``confidence``.
    """
    v = VectorAssembler(inputCols=list(feats), outputCol="features", handleInvalid="keep").transform(df)
    out = model.transform(v)
    if prob:
        out = split_probability(out)
        out = out.withColumn("confidence", confidence(F.col("p_healthy"), F.col("p_positive")))
    return out.withColumn("prediction", F.col("prediction").cast("int")) \
        .drop("features", "rawPrediction", "probability")


def score_record(spark: SparkSession, record, model, feats: Sequence[str], model_name: str) -> DataFrame:
    """One record (dict by feature name, absent -> 0.0; or list in
    feature order) -> the 5-field result row."""
    if model is None:
        raise ValueError("Model not trained yet!")
    feats = list(feats)
    if isinstance(record, dict):
        row = {f: float(record[f]) if f in record else 0.0 for f in feats}
    else:
        vals = list(record)
        if len(vals) != len(feats):
            raise ValueError(f"expected {len(feats)} values, got {len(vals)}")
        row = dict(zip(feats, [float(v) for v in vals]))
    df = spark.createDataFrame([tuple(row[f] for f in feats)], ", ".join(f"`{f}` double" for f in feats))
    s = score(df, model, feats)
    f = C.RECORD_FIELDS
    return s.select((F.col("prediction") == 1).alias(f[0]), F.col("p_healthy").alias(f[1]),
                    F.col("p_positive").alias(f[2]), F.col("confidence").alias(f[3]), F.lit(model_name).alias(f[4]))


def score_severity(scored: DataFrame, sev_model, sev_feats: Sequence[str], mae: float = C.SEVERITY_DEFAULT_MAE,
                   pred: str = "prediction", bands: DataFrame | None = None) -> DataFrame:
    """For rows predicted positive only -- regress, clip to [0, 59],
    band with the serving rule, attach the error margin.

    ``sev_model`` is a fitted Spark regression model; it reads its own
    feature vector (absent severity features default to 0.0).
    """
    pos = fill_absent(positives_only(scored, pred), sev_feats, 0.0)
    v = VectorAssembler(inputCols=list(sev_feats), outputCol="_vx_sev_features", handleInvalid="keep").transform(pos)
    m = sev_model.copy({sev_model.getParam("featuresCol"): "_vx_sev_features",
                        sev_model.getParam("predictionCol"): "_vx_sev_raw"})
    out = m.transform(v).withColumn("severity", clip_severity(F.col("_vx_sev_raw")))
    out = band_join(out, "severity", bands, rounding="half_even", out="severity_band", color="severity_color")
    return out.withColumn("severity_margin", F.lit(float(mae))).drop("_vx_sev_features", "_vx_sev_raw")


def severity_linear(scored: DataFrame, coef: dict, intercept: float, mae: float = C.SEVERITY_DEFAULT_MAE,
                    pred: str = "prediction") -> DataFrame:
    """M13 with a fixed linear regressor (column expressions)."""
    pos = fill_absent(scored.where(F.col(pred) == 1), list(coef), 0.0)
    raw = F.lit(float(intercept))
    for f, w in coef.items():
        raw = raw + F.lit(float(w)) * F.col(f"`{f}`")
    out = pos.withColumn("severity", clip_severity(raw))
    out = band_join(out, "severity", None, rounding="half_even", out="severity_band", color="severity_color")
    return out.withColumn("severity_margin", F.lit(float(mae)))


def metrics_document(scored: DataFrame, y: str, model_name: str, model_label: str, dataset_size: int,
                     dataset_note: str, n_features: int, cv_folds: int = C.CV_FOLDS,
                     score_col: str = "p_positive") -> DataFrame:
    """The published metrics row (4-digit rounding, nested confusion matrix)."""
    from .project import round_metrics
    rep = round_metrics(binary_report(scored, y, "prediction", score_col),
                        ["accuracy", "precision", "recall", "f1", "auc"], 4)
    cm = F.array(F.array(F.col("tn"), F.col("fp")), F.array(F.col("fn"), F.col("tp")))
    return rep.select(F.lit(model_name).alias("model_name"), F.lit(model_label).alias("model_label"),
                      "accuracy", "precision", "recall", "f1",
                      F.col("auc").alias("roc_auc"), cm.alias("confusion_matrix"),
                      F.lit(int(dataset_size)).cast("long").alias("dataset_size"),
                      F.lit(dataset_note).alias("dataset_note"), F.lit(int(n_features)).alias("n_features"),
                      F.lit(int(cv_folds)).alias("cv_folds"))


def severity_document(metrics: DataFrame, model_name: str, target: str, dataset_size: int,
                      n_features: int) -> DataFrame:
    """Severity metrics document: MAE / RMSE (2 digits), R^2 (4 digits), sizes
    and the band table as ``array<struct<label, min, max, color>>``."""
    from .joins import bands_table
    spark = metrics.sparkSession
    bands = bands_table(spark).orderBy("lo").agg(F.collect_list(F.struct(
        F.col("label"), F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("color"))).alias("severity_bands"))
    return metrics.select(F.lit(model_name).alias("model"), F.lit(target).alias("target"),
                          F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("r2", 4).alias("r2"),
                          F.lit(int(dataset_size)).cast("long").alias("dataset_size"),
                          F.lit(int(n_features)).cast("long").alias("n_features"),
                          bands.select("severity_bands").scalar().alias("severity_bands"))


def explain_first(z: DataFrame, model, feats: Sequence[str], key: str,
                  background: DataFrame | None = None) -> DataFrame | None:
    """Attribution of the first row (by ``key``) of a standardised upload.

    Tree models -> TreeSHAP; linear models -> w (x - background mean)
    (background mean 0 when none is given: standardised features); any other
    model -> sampling Shapley over a background of at most 50 rows.  Long
    form ``(key, feature_idx, feature, value)``; None when nothing applies.
    """
    from .explain import linear_attribution, sampling_shapley
    from .treeshap import tree_attribution
    first = z.orderBy(key).limit(1)
    feats = list(feats)
    if hasattr(model, "featureImportances") and hasattr(model, "trees"):
        return tree_attribution(first, key, feats, model)
    if hasattr(model, "coefficients"):
        coef = dict(zip(feats, model.coefficients.toArray().tolist()))
        means = background.agg(*[F.avg(F.col(f"`{f}`")).alias(f) for f in feats]).first().asDict() \
            if background is not None else {f: 0.0 for f in feats}
        return linear_attribution(first, key, coef, means).drop("direction")
    if background is None:
        return None

    def predict(h: DataFrame) -> DataFrame:
        return score(h, model, feats).withColumn("fx", F.col("p_positive"))
    return sampling_shapley(first, key, background, feats, predict)


def analyse(df: DataFrame, model, feats: Sequence[str], scaler_params=None,
            sev_model=None, sev_feats: Sequence[str] = (), label_prefix: str = "Sample",
            order: Sequence[str] = ("row_id",), audio: bool = False,
            background: DataFrame | None = None, explain: bool = True, ts=None) -> dict:
    """Select -> standardise -> score -> log rows -> severity -> first-row
    attribution -> global importance.

    Returns a dict of DataFrames: ``scored``, ``log`` (typed log rows),
    ``severity`` (positives only, when a severity model is given),
    ``attribution`` (first row by ``order[0]``; may be None) and
    ``importance`` (top 12; None for models without one).  ``explain=False``
    leaves the attribution out; an explainer that fails raises.  ``ts`` is the
    time written to the log, the time of this call when absent, so that
    every later read of the log agrees.
    """
    from datetime import datetime, timezone

    from .explain import feature_importance, top_importance
    from .joins import apply_scaler
    from .project import result_text, row_labels
    x = select_if_complete(df, list(feats) + [c for c in order if c in df.columns]) if all(
        f in df.columns for f in feats) else df
    missing = [f for f in feats if f not in x.columns]
    if missing:
        raise KeyError(f"input lacks features {missing}; use fill_absent to default them")
    z = apply_scaler(x, scaler_params, feats) if scaler_params is not None else x
    s = score(z, model, feats)
    log = row_labels(result_text(s, "prediction", audio), label_prefix, list(order), out="label")
    log = log.select(F.lit(ts or datetime.now(timezone.utc)).cast("timestamp").alias("ts"), "label", "input_type", "result", "p_positive", "confidence")
    out = {"scored": s, "log": log}
    if sev_model is not None:
        out["severity"] = score_severity(s, sev_model, sev_feats)
    out["attribution"] = explain_first(z, model, feats, order[0], background) if explain else None
    imp = feature_importance(df.sparkSession, model, list(feats))
    out["importance"] = top_importance(imp) if imp is not None else None
    return out


__all__ = ["score", "score_record", "score_severity", "severity_linear", "metrics_document", "severity_document",
           "explain_first", "analyse"]
