"""Golden values of the screening application (FIXTURES.md section C)."""

import math

import pytest
from pyspark.sql import functions as F

from voxlab import constants as C
from voxlab.functions.scalar import band_case, risk_tier, safe_number, target_size
from voxlab.operators import metrics as M
from voxlab.operators import signal as SG
from voxlab.operators.correlation import correlation_dimension
from voxlab.operators.joins import band_join
from voxlab.operators.stats import fit_scaler


def _confusion_rows(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame(rows, "status int, prediction int")


def test_published_metrics_from_confusion(spark):
    r = M.binary_metrics(_confusion_rows(spark, 45, 3, 0, 147)).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (45, 3, 0, 147)
    assert round(r.accuracy, 4) == 0.9846
    assert round(r.precision, 2) == 0.98
    assert r.recall == 1.0
    assert round(r.f1, 4) == 0.9899


def test_zero_division(spark):
    r = M.binary_metrics(_confusion_rows(spark, 5, 0, 3, 0)).first()
    assert r.precision == 0.0 and r.f1 == 0.0 and r.recall == 0.0


def test_band_rules(spark):
    df = spark.createDataFrame([(x,) for x in [10.0, 10.4, 11.0, 58.5, 59.0, -1.0]], "s double")
    got = [r.band for r in band_join(df, "s", rounding=None).orderBy(F.monotonically_increasing_id()).collect()]
    by = {r.s: r.band for r in band_join(df, "s", rounding=None).collect()}
    assert [by[x] for x in [10.0, 10.4, 11.0, 58.5, 59.0, -1.0]] == \
        ["None / Minimal", "Severe", "Mild", "Severe", "Severe", "Severe"]
    assert len(got) == 6
    df2 = spark.createDataFrame([(x,) for x in [10.4, 10.5, 30.5, 58.5, 58.6]], "s double")
    by2 = {r.s: r.band for r in band_join(df2, "s", rounding="half_even").collect()}
    assert [by2[x] for x in [10.4, 10.5, 30.5, 58.5, 58.6]] == \
        ["None / Minimal", "None / Minimal", "Mild", "Moderate", "Severe"]
    # the CASE form agrees with the join
    by3 = {r.s: r.b for r in df2.select("s", band_case(F.col("s"), "half_even").alias("b")).collect()}
    assert by3 == by2


def test_risk_tier(spark):
    df = spark.createDataFrame([(39.9,), (40.0,), (60.0,)], "p double")
    assert [r.t for r in df.select(risk_tier("p").alias("t")).collect()] == ["green", "amber", "red"]


def test_oversample_target(spark):
    df = spark.createDataFrame([(4817,), (4818,)], "n long")
    assert [r.t for r in df.select(target_size("n").alias("t")).collect()] == [1204, 1204]


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    r = fit_scaler(df, ["x"]).first()
    assert math.isclose(r["mu_x"], 7 / 3)
    assert round(r["sd_x"], 6) == 1.247219
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert fit_scaler(const, ["x"]).first()["sd_x"] == 1.0


def _frames(spark, rec, values):
    return spark.createDataFrame([(rec, i, float(v)) for i, v in enumerate(values)],
                                 "recording_id long, frame_idx long, f0 double")


def test_constant_series(spark):
    fr = _frames(spark, 1, [5.0] * 12)
    assert SG.rpde(fr).first().RPDE == 0.0
    assert SG.ppe(fr).first().PPE == 0.0
    s = SG.spreads(fr).first()
    assert s.spread1 == -2.0 and s.spread2 == 0.0


def test_short_series_defaults(spark):
    fr = _frames(spark, 1, [100.0, 110.0, 105.0, 120.0])
    assert SG.rpde(fr).first().RPDE == C.DEFAULT_RPDE
    assert SG.ppe(fr).first().PPE == C.DEFAULT_PPE
    s = SG.spreads(fr).first()
    assert (s.spread1, s.spread2) == (C.DEFAULT_SPREAD1, C.DEFAULT_SPREAD2)
    assert correlation_dimension(fr).first().D2 == C.DEFAULT_D2
    assert SG.dfa(SG.dfa_signal(fr), all_recordings=SG.recordings(fr)).first().DFA == C.DEFAULT_DFA


def test_nhr(spark):
    fr = spark.createDataFrame([(1, 0, 100.0, 100.0 / 101.0), (2, 0, 100.0, 0.5)],
                               "recording_id long, frame_idx long, f0 double, r double")
    got = {r.recording_id: (r.HNR, r.NHR) for r in SG.harmonicity(fr).collect()}
    assert abs(got[1][0] - 20.0) < 1e-9 and abs(got[1][1] - 0.05) < 1e-8
    assert got[2] == (0.0, 0.1)


def test_safe_number(spark):
    df = spark.createDataFrame([(None,), ("NaN",), ("x",), ("0",), ("2.5",)], "v string")
    assert [r.n for r in df.select(safe_number("v").alias("n")).collect()] == [0.0, 0.0, 0.0, 0.0, 2.5]


def test_geometric_scales(spark):
    df = spark.createDataFrame([(2000,)], "L long")
    assert df.select(SG.geometric_scales(F.col("L")).alias("s")).first().s == \
        [4, 6, 9, 14, 23, 35, 55, 86, 133, 207, 322, 500]


def test_auc_ties(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], "status int, score double")
    assert M.roc_auc(df, "status", "score").first().auc == 0.5


def test_events_series_golden(spark):
    """DFA slope and density entropy of users 0, 1, 2 at sf0.01 (4 digits)."""
    from voxlab.sources.tables import series_frames
    fr = series_frames(spark, "/root/testdata/sf0.01").where(F.col("recording_id") < 3)
    dfa = {r.recording_id: round(r.DFA, 4) for r in SG.dfa(SG.dfa_signal(fr)).collect()}
    assert [dfa[i] for i in range(3)] == [0.5718, 0.7550, 0.6548]
    ent = {r.recording_id: round(r.RPDE, 4) for r in SG.rpde(fr).collect()}
    assert [ent[i] for i in range(3)] == [0.1754, 0.1478, 0.1072]


def test_severity_document_bands(spark):
    from voxlab.operators.scoring import severity_document
    m = spark.createDataFrame([(10, 5.2049, 6.5111, 0.33674)], "n long, mae double, rmse double, r2 double")
    d = severity_document(m, "GBTRegressionModel", "motor_UPDRS", 5875, 16).first()
    assert (d.mae, d.rmse, d.r2, d.dataset_size, d.n_features) == (5.2, 6.51, 0.3367, 5875, 16)
    assert [(b.label, b.min, b.max, b.color) for b in d.severity_bands] == [
        ("None / Minimal", 0, 10, "#27AE60"), ("Mild", 11, 30, "#F39C12"),
        ("Moderate", 31, 58, "#E67E22"), ("Severe", 59, 200, "#E74C3C")]


def test_safe_number_on_columns(spark):
    df = spark.createDataFrame([("abc", 1.5), (None, float("nan")), ("3", 0.0)], "s string, d double")
    got = df.select(safe_number(F.col("s")).alias("a"), safe_number(F.col("d")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(0.0, 1.5), (0.0, 0.0), (3.0, 0.0)]
