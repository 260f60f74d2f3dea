"""Splits, folds, kNN, oversampling and metrics: properties and brute force."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlab.operators import metrics as M
from voxlab.operators.neighbours import knn_self
from voxlab.operators.sampling import assign_folds, split_plain, split_stratified, smote
from voxlab.sources.tables import labelled_events

SF = "/root/testdata/sf0.001"


def test_stratified_split_disjoint_complete(spark):
    df = labelled_events(spark, SF)
    s = split_stratified(df, "event_id", "status").cache()
    assert s.count() == df.count()
    assert s.select("event_id").distinct().count() == df.count()
    per = {(r.status, r.is_test): r.c for r in s.groupBy("status", "is_test").agg(F.count("*").alias("c")).collect()}
    for y in (0, 1):
        n = per.get((y, True), 0) + per.get((y, False), 0)
        assert per.get((y, True), 0) == round(0.2 * n)


def test_folds_balanced(spark):
    df = labelled_events(spark, SF)
    f = assign_folds(df, "event_id", "status", k=5)
    c = f.groupBy("status", "fold").count().collect()
    by = {}
    for r in c:
        by.setdefault(r.status, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in by.values())


def test_split_by_subject_keeps_groups_whole(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    s = split_plain(o, "o_orderkey", group_col="o_custkey")
    assert s.groupBy("o_custkey").agg(F.countDistinct("is_test").alias("k")).where("k > 1").count() == 0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.integers(0, 6, size=(120, 3)).astype(float)  # many exact ties
    y = rng.integers(0, 2, size=120)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, X[i])) for i in range(120)], "id long, g int, a double, b double, c double")
    got = {(r.id, r.pos): r.nn_id for r in knn_self(df, "id", ["a", "b", "c"], k=4, by=["g"]).collect()}
    for i in range(120):
        idx = np.where(y == y[i])[0]
        idx = idx[idx != i]
        d = ((X[idx] - X[i]) ** 2).sum(1)
        order = idx[np.lexsort((idx, d))][:4]
        assert [got[(i, p)] for p in range(1, 5)] == list(order)


def test_smote_rows_on_parent_segments(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0 if i < 15 else 1, float(rng.normal()), float(rng.normal())) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    s = smote(df, "id", ["a", "b"], "y", minority=0, majority=1, ratio=0.5, k=3).collect()
    assert len(s) == int(85 * 0.5) - 15
    X = {r[0]: np.array(r[2:]) for r in rows}
    for r in s:
        p, n, v = X[r.parent_id], X[r.nn_id], np.array([r.a, r.b])
        t = np.dot(v - p, n - p) / max(np.dot(n - p, n - p), 1e-300)
        assert -1e-9 <= t <= 1 + 1e-9 and np.allclose(p + t * (n - p), v)


auc_rows = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(auc_rows)
def test_auc_brute_force_and_monotone(spark, rows):
    ys = [y for y, _ in rows]
    if len(set(ys)) < 2:
        return
    df = spark.createDataFrame([(y, float(s)) for y, s in rows], "status int, score double")
    auc = M.roc_auc(df, "status", "score").first().auc
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    ref = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - ref) < 1e-12
    mono = M.roc_auc(df.withColumn("score", F.exp(F.col("score")) * 3 - 7), "status", "score").first().auc
    assert abs(mono - auc) < 1e-12


def test_regression_metrics(spark):
    y = np.array([3.0, -0.5, 2.0, 7.0])
    p = np.array([2.5, 0.0, 2.0, 8.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert abs(r.mae - 0.5) < 1e-12
    assert abs(r.rmse - np.sqrt(0.375)) < 1e-12
    assert abs(r.r2 - (1 - 1.5 / np.sum((y - y.mean()) ** 2))) < 1e-12


def test_union_count_is_sum(spark):
    from voxlab.plans.explore import union_sets
    u = union_sets(spark, SF)
    ev = spark.read.parquet(f"{SF}/events.parquet").count()
    od = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert u.count() == ev + od
    assert u.where("source = 'longitudinal' AND status <> 1").count() == 0


def test_corr_matrix_methods_agree(spark):
    from voxlab.operators.stats import corr_matrix
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    a = {(r.row_feature, r.col_feature): r.r for r in corr_matrix(li, cols, 6).collect()}
    b = {(r.row_feature, r.col_feature): r.r for r in corr_matrix(li, cols, 6, method="ml").collect()}
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-6 for k in a)
