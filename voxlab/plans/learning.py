"""Learner queries (rows-only checks: fitted models are not SQL).

Grids: ``model_selection`` and ``severity_training`` run the library defaults,
the screening application's full grids (44 classifier points, 16 regressor
points, 5 folds) with the solvers' own iterations.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import explain as X
from ..operators.learn import fit_severity, model_selection, scaler_stage, standardise
from ..operators.metrics import regression_metrics
from ..operators.project import assemble as _assemble
from ..operators.sampling import assign_folds, smote, split_plain, split_stratified
from ..operators.scoring import analyse, score, score_record
from ..operators.treeshap import tree_attribution
from ..session import cut_lineage, drop_cut, scratch_path
from ..sources import io as IO
from ..sources.tables import EVENT_FEATURES, labelled_events, longitudinal_orders

# one point a family; the support vector machine's solver is cut short, as only the round trip is shown
BUNDLE_GRIDS = {
    "Logistic Regression": {"C": [0.1, 1.0]},
    "Random Forest": {"n_estimators": [20], "max_depth": [5], "min_samples_split": [2]},
    "SVM": {"C": [1.0], "kernel": ["rbf"], "gamma": ["scale"], "max_iter": [20], "n_components": [16]},
    "Boosted Trees": {"n_estimators": [20], "max_depth": [3], "learning_rate": [0.1], "subsample": [1.0]},
}
# the severity stand-in is a user's mean, so that mean is no feature
BAND_FEATURES = [f for f in EVENT_FEATURES if f != "user_mean"]
SEV_FEATURES = ["year", "month", "dow", "priority", "is_f"]


def assemble(feats, out: str, df: DataFrame) -> DataFrame:
    """P12 with the frame last, as the calls below read."""
    return _assemble(df, feats, out)


def prepared_events(spark: SparkSession, sf: str):
    """Split -> scale on train -> oversample the minority (purchases) -> folds."""
    df = split_stratified(cut_lineage(labelled_events(spark, sf).drop("user_id")), "event_id", "status", written=True)
    # both parts are projections of the written table
    tr, te, params = standardise(df.where(~F.col("is_test")), df.where(F.col("is_test")), EVENT_FEATURES)
    syn = smote(tr, "event_id", EVENT_FEATURES, "status", minority=1, majority=0)
    syn = syn.select((F.lit(-1) - F.col("syn_id")).alias("event_id"), "status", *EVENT_FEATURES)
    bal = tr.select("event_id", "status", *EVENT_FEATURES).unionByName(syn)
    bal = cut_lineage(assign_folds(bal, "event_id", "status"))
    return bal, te, params


def q_model_selection(spark: SparkSession, sf: str) -> DataFrame:
    """E1 end to end: split -> scale -> oversample -> k-fold search per family
    -> hold-out report -> best family (strict >, declaration order) -> its
    metrics on the whole labelled set published as JSON and the model saved,
    both in the shared folder and read back."""
    from ..operators.scoring import metrics_document, score
    bal, te, params = prepared_events(spark, sf)
    sel = model_selection(bal, te, EVENT_FEATURES)
    best = sel.best_name
    # publish: the chosen model on the whole labelled set, scaled with the training constants
    from ..operators.joins import apply_scaler
    path = scratch_path(spark, "best-bundle")
    IO.save_bundle(spark, path, sel.best_model, EVENT_FEATURES, params.first().asDict())
    model, feats, scaler = IO.load_bundle(spark, path)
    full = apply_scaler(labelled_events(spark, sf), scaler, feats)
    # the document's parts read scores made once
    scored = cut_lineage(score(full, model, feats).select("status", "prediction", "p_positive"))
    doc = metrics_document(scored, "status", type(sel.best_model).__name__, best, full.count(),
                           "events stand-in", len(EVENT_FEATURES))
    mpath = scratch_path(spark, "metrics")
    IO.write_metrics(doc, mpath)
    published = IO.read_metrics(spark, mpath).select(F.col("model_label").alias("family"),
                                                     F.col("roc_auc").alias("published_roc_auc"))
    return sel.results.select("family", F.to_json("params").alias("params"), F.round("cv_auc", 4).alias("cv_auc"),
                              "chosen", F.round("test_auc", 4).alias("test_auc"),
                              (F.col("family") == F.lit(best)).alias("best_family")) \
        .join(published, "family", "left")


def q_severity_training(spark: SparkSession, sf: str) -> DataFrame:
    """E4 end to end: plain split -> scale -> k-fold search on MAE -> hold-out
    errors -> severity metrics document (with the band table) published as
    JSON and the model saved, both in the shared folder and read back."""
    from ..operators.scoring import severity_document
    o = cut_lineage(split_plain(longitudinal_orders(spark, sf), "o_orderkey"))
    tr, te, params = standardise(o.where(~F.col("is_test")), o.where(F.col("is_test")), SEV_FEATURES)
    tr = cut_lineage(assign_folds(tr, "o_orderkey"))
    model, best, scores = fit_severity(tr, SEV_FEATURES, "target")
    pred = model.transform(assemble(SEV_FEATURES, "features", te))
    m = regression_metrics(pred, "target", "prediction")
    doc = severity_document(m, type(model).__name__, "target", o.count(), len(SEV_FEATURES))
    path = scratch_path(spark, "severity-metrics")
    IO.write_metrics(doc, path)
    IO.save_bundle(spark, scratch_path(spark, "severity-bundle"), model, SEV_FEATURES, params.first().asDict())
    back = IO.read_metrics(spark, path)
    return back.select("n_features", "mae", "rmse", "r2", F.size("severity_bands").alias("n_bands"),
                       F.lit(int(best["n_estimators"])).alias("n_estimators"),
                       F.lit(int(best["max_depth"])).alias("max_depth"))


def _fit_boosted(spark, sf):
    bal, te, params = prepared_events(spark, sf)
    v = assemble(EVENT_FEATURES, "features", bal) \
        .withColumn("label", F.col("status").cast("double"))
    # predictions are kept by the trainer, so their lineage needs no copies in the checkpoint folder
    model = GBTClassifier(maxIter=20, maxDepth=3, seed=C.SEED, checkpointInterval=-1).fit(v)
    drop_cut(bal)
    return model, te


def q_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _fit_boosted(spark, sf)
    return X.top_importance(X.feature_importance(spark, model, EVENT_FEATURES), C.TOP_IMPORTANCE)


def q_tree_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Tree attributions of every hold-out row, top 14 by |value| per row."""
    model, te = _fit_boosted(spark, sf)
    att = tree_attribution(te, "event_id", EVENT_FEATURES, model)
    return X.rank_abs(att, "event_id", C.TOP_ATTRIBUTION).select(
        "event_id", "feature", F.round("value", 6).alias("value"), "rank")


def _fit_pipeline(spark, sf):
    df = cut_lineage(split_stratified(labelled_events(spark, sf), "event_id", "status"))
    train = df.where(~F.col("is_test"))
    from ..operators.stats import fit_scaler
    params = fit_scaler(train, EVENT_FEATURES).first().asDict()
    pipe = Pipeline(stages=[scaler_stage(params, EVENT_FEATURES),
                            VectorAssembler(inputCols=EVENT_FEATURES, outputCol="features"),
                            LogisticRegression(regParam=0.01, maxIter=100, labelCol="label")])
    model = pipe.fit(train.withColumn("label", F.col("status").cast("double")))
    return model, df


def q_pipeline_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Fit, save to the shared folder, load, score the hold-out rows."""
    model, df = _fit_pipeline(spark, sf)
    path = scratch_path(spark, "pipeline")
    IO.save_pipeline(model, path)
    loaded = IO.load_pipeline(path)
    assert IO.load_pipeline(path + "-absent", optional=True) is None
    out = loaded.transform(df.where(F.col("is_test")))
    from ..operators.project import split_probability
    return split_probability(out).select("event_id", "status", F.col("prediction").cast("int").alias("prediction"),
                                         F.round("p_positive", 6).alias("p_positive"))


def q_record_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """The first labelled row (by key) as a dict with one feature
    missing (defaults to 0.0), scored by a fitted model."""
    df = labelled_events(spark, sf)
    z, _, _ = standardise(df, None, EVENT_FEATURES)
    v = assemble(EVENT_FEATURES, "features", z) \
        .withColumn("label", F.col("status").cast("double"))
    lr = LogisticRegression(regParam=0.01, maxIter=100).fit(v)
    first = z.orderBy("event_id").limit(1).first().asDict()
    rec = {f: first[f] for f in EVENT_FEATURES[:-1]}
    return score_record(spark, rec, lr, EVENT_FEATURES, "Logistic Regression")


def q_upload_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """M20 on the hold-out rows as one upload: scale, score, append the log
    rows to the shared folder, estimate severity for the positives; returns
    the log as read back with the severity band of each positive row."""
    from pyspark.ml.regression import LinearRegression
    from ..operators.joins import apply_scaler
    from ..operators.stats import fit_scaler
    df = cut_lineage(split_stratified(labelled_events(spark, sf), "event_id", "status"))
    train = df.where(~F.col("is_test"))
    params = fit_scaler(train, EVENT_FEATURES)
    tz = assemble(EVENT_FEATURES, "features", 
        apply_scaler(train, params, EVENT_FEATURES))
    lr = LogisticRegression(regParam=0.01, maxIter=100, threshold=0.2).fit(
        tz.withColumn("label", F.col("status").cast("double")))
    sev_model = LinearRegression(maxIter=20, featuresCol="sev").fit(
        assemble(BAND_FEATURES, "sev", tz).withColumn("label", F.lit(30.0) + 10 * F.col("user_mean")))
    sev_model.setFeaturesCol("features")
    res = analyse(df.where(F.col("is_test")), lr, EVENT_FEATURES, params, sev_model, BAND_FEATURES,
                  order=["event_id"])
    log_path = scratch_path(spark, "prediction-log")
    IO.append_log(res["log"], log_path)
    log = IO.read_log(spark, log_path)
    return log.select("label", "result", F.round("p_positive", 6).alias("p_positive"), "input_type")


def q_severity_bands(spark: SparkSession, sf: str) -> DataFrame:
    """M13 with a fitted regressor: band of every positive hold-out row."""
    from pyspark.ml.regression import LinearRegression
    from ..operators.joins import apply_scaler
    from ..operators.stats import fit_scaler
    from ..operators.scoring import score_severity
    df = cut_lineage(split_stratified(labelled_events(spark, sf), "event_id", "status"))
    train = df.where(~F.col("is_test"))
    params = fit_scaler(train, EVENT_FEATURES)
    tz = assemble(EVENT_FEATURES, "features", 
        apply_scaler(train, params, EVENT_FEATURES))
    # decision threshold at the class prior (purchases are about 20 % of events)
    lr = LogisticRegression(regParam=0.01, maxIter=100, threshold=0.2).fit(
        tz.withColumn("label", F.col("status").cast("double")))
    sev_model = LinearRegression(maxIter=20, featuresCol="sev").fit(
        assemble(BAND_FEATURES, "sev", tz).withColumn("label", F.lit(30.0) + 10 * F.col("user_mean")))
    sev_model.setFeaturesCol("features")
    scored = score(apply_scaler(df.where(F.col("is_test")), params, EVENT_FEATURES), lr, EVENT_FEATURES)
    s = score_severity(scored, sev_model, BAND_FEATURES)
    return s.select("event_id", F.round("severity", 4).alias("severity"), "severity_band", "severity_margin")


def q_upload_explanation(spark: SparkSession, sf: str) -> DataFrame:
    """M20 explanation part: the hold-out rows as one upload scored by a
    boosted-tree model; attribution of its first row and global importance,
    in one long table ``(kind, feature, value)``."""
    from ..operators.joins import apply_scaler
    from ..operators.stats import fit_scaler
    df = cut_lineage(split_stratified(labelled_events(spark, sf), "event_id", "status"))
    train = df.where(~F.col("is_test"))
    params = fit_scaler(train, EVENT_FEATURES)
    tz = assemble(EVENT_FEATURES, "features", 
        apply_scaler(train, params, EVENT_FEATURES)).withColumn("label", F.col("status").cast("double"))
    gbt = GBTClassifier(maxIter=20, maxDepth=3, seed=C.SEED).fit(tz)
    res = analyse(df.where(F.col("is_test")), gbt, EVENT_FEATURES, params, order=["event_id"])
    att = res["attribution"].select(F.lit("attribution").alias("kind"), "feature", F.round("value", 6).alias("value"))
    imp = res["importance"].select(F.lit("importance").alias("kind"), "feature", F.round("importance", 6).alias("value"))
    return att.unionByName(imp)


def q_recording_screening(spark: SparkSession, sf: str) -> DataFrame:
    """E3 end to end: series -> 22 voice measures per recording -> the 16
    common features -> standardise -> classifier -> log rows labelled
    'Recording n' with input type Audio.  Label of a recording (stand-in):
    more than 20 % of its events are purchases."""
    from ..operators.project import common_columns
    from ..operators.stats import fit_scaler
    from ..operators.voice import voice_features
    from ..sources.tables import pulses_from_frames, read_table
    from .signals import frames_r
    # the frames are ranked and written once; pulses derive from them
    vf = voice_features(frames_r(spark, sf), pulses_from_frames)
    ev = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("recording_id")).agg(
        (F.avg((F.col("event_type") == "purchase").cast("double")) > 0.2).cast("int").alias("status"))
    data = cut_lineage(vf.join(ev, "recording_id"))
    feats = common_columns(data, C.COMMON_FEATURES)
    data = cut_lineage(split_stratified(data, "recording_id", "status"))
    train = data.where(~F.col("is_test"))
    params = fit_scaler(train, feats)
    from ..operators.joins import apply_scaler
    z = assemble(feats, "features", apply_scaler(train, params, feats)) \
        .withColumn("label", F.col("status").cast("double"))
    lr = LogisticRegression(regParam=0.1, maxIter=100).fit(z)
    res = analyse(data.where(F.col("is_test")), lr, feats, params, label_prefix="Recording", order=["recording_id"], audio=True)
    return res["log"].select("label", "input_type", "result", F.round("p_positive", 6).alias("p_positive"))


def _holdout_sql() -> str:
    """Number of hold-out rows: a fifth of each class, rounded."""
    return ("SELECT CAST(sum(round(0.2 * n)) AS BIGINT) FROM (SELECT count(*) AS n FROM events "
            "GROUP BY CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)")


def q_bundle_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """IO7 / IO8 / M11 for every family: train, save model + scaler + features as one bundle, load it, score the
    hold-out rows of a new file with what was loaded; rows say whether the scores are those of the fitted model."""
    from ..operators.joins import apply_scaler
    from ..operators.learn import families
    from ..operators.stats import fit_scaler
    df = cut_lineage(split_stratified(labelled_events(spark, sf), "event_id", "status"))
    train = df.where(~F.col("is_test"))
    scaler = fit_scaler(train, EVENT_FEATURES).first().asDict()
    tz = assemble(EVENT_FEATURES, "features", apply_scaler(train, scaler, EVENT_FEATURES)) \
        .select("features", F.col("status").cast("double").alias("label"))
    tz = IO.cached(tz)
    n, out = tz.count(), None
    for fam in families(BUNDLE_GRIDS):
        fitted = fam.build(fam.grid[-1], n, len(EVENT_FEATURES)).fit(tz)
        path = scratch_path(spark, "bundle")
        IO.save_bundle(spark, path, fitted, EVENT_FEATURES, scaler)
        model, feats, params = IO.load_bundle(spark, path)
        test = df.where(F.col("is_test"))
        a = score(apply_scaler(test, params, feats), model, feats).select("event_id", "p_healthy", "p_positive", "prediction")
        b = score(apply_scaler(test, scaler, EVENT_FEATURES), fitted, EVENT_FEATURES).select("event_id", F.col("p_positive").alias("p"))
        row = a.join(b, "event_id").agg(
            F.lit(fam.name).alias("family"), F.count(F.lit(1)).alias("n"),
            (F.max(F.abs(F.col("p") - F.col("p_positive"))) == 0).alias("same_scores"),
            (F.max(F.abs(F.col("p_healthy") + F.col("p_positive") - 1)) < 1e-9).alias("sums_to_one"),
            F.lit(len(feats)).alias("n_features"))
        out = row if out is None else out.unionByName(row)
    out = cut_lineage(out)
    tz.unpersist()
    return out


SQL_BUNDLE_ROUNDTRIP = ("SELECT family, (" + _holdout_sql() + ") AS n, TRUE AS same_scores, TRUE AS sums_to_one, 5 AS n_features "
                        "FROM (VALUES " + ", ".join(f"('{f}')" for f in C.FAMILY_ORDER) + ") t(family)")


def q_upload_whole(spark: SparkSession, sf: str) -> DataFrame:
    """M20 whole: log, severity, attribution and importance of one upload, with the properties they must have."""
    from pyspark.ml.regression import LinearRegression

    from ..operators.joins import apply_scaler
    from ..operators.stats import fit_scaler
    from ..operators.treeshap import tree_attribution
    df = cut_lineage(split_stratified(labelled_events(spark, sf), "event_id", "status"))
    train = df.where(~F.col("is_test"))
    params = fit_scaler(train, EVENT_FEATURES).first().asDict()
    z = apply_scaler(train, params, EVENT_FEATURES)
    tz = assemble(EVENT_FEATURES, "features", z).withColumn("label", F.col("status").cast("double"))
    gbt = GBTClassifier(maxIter=10, maxDepth=3, seed=C.SEED).fit(tz)
    sev = LinearRegression(maxIter=20).fit(assemble(BAND_FEATURES, "features", z)
                                           .withColumn("label", F.lit(30.0) + 10 * F.col("user_mean")))
    upload = df.where(F.col("is_test"))
    res = analyse(upload, gbt, EVENT_FEATURES, params, sev, BAND_FEATURES, order=["event_id"])
    log, severity = cut_lineage(res["log"]), cut_lineage(res["severity"])
    att = tree_attribution(apply_scaler(upload, params, EVENT_FEATURES), "event_id", EVENT_FEATURES, gbt)
    margin = gbt.transform(assemble(EVENT_FEATURES, "features", apply_scaler(upload, params, EVENT_FEATURES)))
    from pyspark.ml.functions import vector_to_array
    margin = margin.select("event_id", (vector_to_array(F.col("rawPrediction"))[1] / 2).alias("m"), vector_to_array(F.col("rawPrediction"))[1].alias("m2"))
    add = att.groupBy("event_id").agg((F.sum("value") + F.first("base_value")).alias("total")).join(margin, "event_id") \
        .agg(F.least(F.max(F.abs(F.col("total") - F.col("m"))), F.max(F.abs(F.col("total") - F.col("m2")))).alias("e"), F.count(F.lit(1)).alias("n"))
    positives = log.where(F.col("p_positive") >= 0.5).count()
    return log.agg(F.count(F.lit(1)).alias("log_rows"), (F.count_distinct("ts") == 1).alias("one_time")) \
        .join(severity.agg((F.count(F.lit(1)) == positives).alias("severity_for_positives"),
                           F.coalesce(F.min("severity") >= 0, F.lit(True)).alias("severity_clipped"),
                           (F.count_if(F.col("severity_band").isNull()) == 0).alias("all_banded"))) \
        .join(res["attribution"].agg(F.count(F.lit(1)).alias("attribution_rows"))) \
        .join(add.select((F.col("e") < 1e-6).alias("additive"), F.col("n").alias("attributed_rows")))


SQL_UPLOAD_WHOLE = ("SELECT h AS log_rows, TRUE AS one_time, TRUE AS severity_for_positives, TRUE AS severity_clipped, TRUE AS all_banded, "
                    "CAST(5 AS BIGINT) AS attribution_rows, TRUE AS additive, h AS attributed_rows FROM (SELECT (" + _holdout_sql() + ") AS h)")


QUERIES = {
    "bundle_roundtrip": (q_bundle_roundtrip, SQL_BUNDLE_ROUNDTRIP),
    "upload_whole": (q_upload_whole, SQL_UPLOAD_WHOLE),
    "model_selection": (q_model_selection, None),
    "severity_training": (q_severity_training, None),
    "feature_importance": (q_feature_importance, None),
    "tree_attribution": (q_tree_attribution, None),
    "pipeline_roundtrip": (q_pipeline_roundtrip, None),
    "record_scoring": (q_record_scoring, None),
    "upload_analysis": (q_upload_analysis, None),
    "severity_bands": (q_severity_bands, None),
    "upload_explanation": (q_upload_explanation, None),
    "recording_screening": (q_recording_screening, None),
}
