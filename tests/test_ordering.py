"""Bucketed exact ranks, prefix sums and percentiles equal the plain window forms."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxlab.operators.ordering import exact_percentiles, exact_rank, prefix_sums, value_bucket

values = st.lists(st.tuples(st.integers(0, 3), st.floats(-1e6, 1e6, allow_nan=False, width=32)),
                  min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values)
def test_rank_matches_row_number(spark, rows):
    df = spark.createDataFrame([(g, float(x), i) for i, (g, x) in enumerate(rows)], "g int, x double, id long")
    got = exact_rank(df, ["g"], ["x", "id"], value_bucket(F.col("x"), 4), out="r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")))
    assert sorted(map(tuple, got.select("id", "r").collect())) == sorted(map(tuple, ref.select("id", "r").collect()))


def test_prefix_sums_global(spark):
    rng = np.random.default_rng(1)
    xs = rng.normal(size=500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i long, x double")
    got = prefix_sums(df, [], ["i"], F.floor(F.col("i") / 37), {"c": F.col("x")}, inclusive=False)
    got = {r.i: r.c for r in got.collect()}
    ref = np.concatenate([[0.0], np.cumsum(xs)[:-1]])
    assert all(abs(got[i] - ref[i]) < 1e-9 for i in range(500))


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 400), rng.exponential(5, 400).round(2))]
    df = spark.createDataFrame(rows, "g int, x double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.p): r.value for r in exact_percentiles(df, ["g"], "x", ps).collect()}
    for g in range(3):
        arr = np.array([x for gg, x in rows if gg == g])
        for p in ps:
            assert abs(got[(g, p)] - np.percentile(arr, p * 100)) < 1e-9


def test_value_bucket_monotone(spark):
    xs = sorted([-1e9, -3.5, -1.0, -1e-200, 0.0, 1e-300, 2e-300, 0.001, 1.0, 1.0001, 7.0, 1e12])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    b = [r.b for r in df.select("i", value_bucket(F.col("x")).alias("b")).orderBy("i").collect()]
    assert b == sorted(b)


def test_percentiles_heavy_duplicates(spark):
    rng = np.random.default_rng(11)
    vals = rng.integers(0, 5, 3000).astype(float)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(vals)], "g int, x double")
    ps = [0.01, 0.25, 0.5, 0.77, 0.99]
    got = {(r.g, r.p): r.value for r in exact_percentiles(df, ["g"], "x", ps).collect()}
    for g in range(2):
        arr = vals[g::2]
        for p in ps:
            assert abs(got[(g, p)] - np.percentile(arr, p * 100)) < 1e-12


def test_refined_bucket_rank_exact(spark):
    from voxlab.operators.ordering import refined_bucket
    rng = np.random.default_rng(3)
    # a burst: most rows of group 0 fall in one coarse bucket
    keys = np.concatenate([rng.integers(0, 1000, 300), rng.integers(0, 100000, 60)])
    rows = [(int(i % 2 == 0 or i < 300), int(k), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "g int, k long, id long")
    b = refined_bucket(df, ["g"], F.col("k"), coarse=10000, fine=10, limit=20)
    got = exact_rank(b, ["g"], ["k", "id"], F.col("_vx_rb"), out="r").select("id", "r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k", "id"))).select("id", "r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))
    assert b.where("_vx_rb.f <> 0").count() > 0


def test_approx_percentiles_close_to_exact(spark):
    from voxlab.operators.stats import percentiles
    rng = np.random.default_rng(5)
    vals = rng.normal(size=5000)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(vals)], "g int, x double")
    ex = {(r.g, r.p): r.value for r in percentiles(df, "x", [0.25, 0.5, 0.75], ["g"]).collect()}
    ap = {(r.g, r.p): r.value for r in percentiles(df, "x", [0.25, 0.5, 0.75], ["g"], approx=True).collect()}
    assert set(ex) == set(ap) and all(abs(ex[k] - ap[k]) < 0.05 for k in ex)


def test_null_groups_are_ranked_like_a_window(spark):
    from voxlab.operators.sampling import assign_folds, split_stratified
    rows = [(i, None if i % 10 == 0 else i % 2, float(i % 7) if i % 5 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, status int, x double")
    for out in (split_stratified(df, "event_id", "status"), assign_folds(df, "event_id", "status")):
        assert out.count() == 100
    r = exact_rank(df, ["status"], ["event_id"], F.col("event_id") % 3 * 0, out="r").orderBy("event_id").collect()
    w = df.withColumn("r", F.row_number().over(Window.partitionBy("status").orderBy("event_id"))).orderBy("event_id").collect()
    assert [x.r for x in r] == [x.r for x in w]


def test_percentiles_without_and_with_null_groups(spark):
    rows = [(None if i % 3 == 0 else "g", float(i * i % 37) if i % 8 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.p: r.value for r in exact_percentiles(df, (), "x", probs).collect()}
    assert got == pytest.approx({p: float(np.quantile([x for _, x in rows if x is not None], p)) for p in probs})
    by = {(r.g, r.p): r.value for r in exact_percentiles(df, ["g"], "x", probs).collect()}
    want = {(g, p): float(np.quantile([x for h, x in rows if x is not None and h == g], p)) for g in (None, "g") for p in probs}
    assert by == pytest.approx(want)
