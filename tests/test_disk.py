"""What stays on disk: shuffle files of written tables, the text that shuffles carry, tables no longer read."""

import os

from pyspark.sql import functions as F

from voxlab.operators import sampling as S
from voxlab.plans import learning
from voxlab.session import cut_lineage, drop_cut, ensure_checkpoint_dir
from voxlab.sources.tables import labelled_events

from conftest import SF_SMALL


def _shuffle_files(spark) -> set:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 g").repartition(3, "g").groupBy("g").agg(F.sum("id").alias("s"))
    before = _shuffle_files(spark)
    out = cut_lineage(df)
    assert not _shuffle_files(spark) - before
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    drop_cut(out)
    assert not os.path.exists(out._vx_cut.removeprefix("file:"))


def _rows(spark, n=400):
    return spark.createDataFrame([(None if i % 97 == 0 else i, (None, 0, 1, 1)[i % 4], float(i)) for i in range(n)], "k long, status int, x double")


def test_split_of_a_written_table_is_the_ranked_split_without_a_shuffle_of_rows(spark):
    df = _rows(spark).where("k is not null")
    ranked, cut = S.split_stratified(df, "k"), S.split_stratified(cut_lineage(df), "k", written=True)
    assert sorted(map(str, cut.collect())) == sorted(map(str, ranked.collect()))
    assert cut.where("is_test").count() > 60
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()


def test_split_cut_between_equal_keys_is_ranked(spark):
    """Each class is one key three times, or null keys: a cut falls between rows of one md5."""
    df = spark.createDataFrame([(None if c else 5, c, float(i)) for c in (0, 1) for i in range(3)], "k long, status int, x double")
    assert S.hash_cuts(df, "k", "status", 0.34) is None
    got = {(r.status, r.is_test): r.c for r in S.split_stratified(df, "k", test=0.34, written=True).groupBy("status", "is_test").agg(F.count("*").alias("c")).collect()}
    assert got == {(0, True): 1, (0, False): 2, (1, True): 1, (1, False): 2}
    none = S.split_stratified(df, "k", test=0.1, written=True)
    assert none.where("is_test").count() == 0 and none.where("not is_test").count() == 6


def test_ranks_by_md5_shuffle_no_text(spark):
    df = _rows(spark).where("k is not null")
    out = S.hash_rank(df, "k", ["status"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):].split("\n")
    assert "md5" not in below[1]
    # dealt once for the windows: nothing but the small table of bucket totals moves again
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 2
    own = {(r.status, r.k): r._vx_rank for r in out.collect()}
    by = {}
    for k, c in sorted(((r.k, r.status) for r in df.collect()), key=lambda r: __import__("hashlib").md5(f"42|{r[0]}".encode()).hexdigest()):
        by.setdefault(c, []).append(k)
    assert own == {(c, k): i for c, ks in by.items() for i, k in enumerate(ks, 1)}


def test_joined_events_shuffle_no_text(spark):
    plan = labelled_events(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "get_json_object" in plan[join:] and "get_json_object" not in plan[:join] and "event_type" not in plan[:join]


def test_boosted_fit_keeps_neither_copies_of_predictions_nor_its_training_table(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    seen = []
    real, learning.drop_cut = learning.drop_cut, lambda df: (seen.append(df._vx_cut), real(df))
    try:
        model, te = learning._fit_boosted(spark, SF_SMALL)
    finally:
        learning.drop_cut = real
    assert model.getNumTrees == 20 and te.count() > 0
    assert len(seen) == 1 and not os.path.exists(seen[0].removeprefix("file:"))
    assert not [d for d in set(os.listdir(root)) - before if d.startswith("rdd-")]
