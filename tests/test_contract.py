"""Driver contract: entry runs, every query has a callable, oracle keys are queries,
and a sample of queries equals its SQL oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"n", "tp", "auc"}


def test_oracle_keys_are_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


@pytest.mark.parametrize("name", ["holdout_screening", "band_serving", "percentiles", "violin_summary", "rpde",
                                  "jitter", "correlation_dimension", "smote", "class_report", "stream_window_tally",
                                  "nth_order", "linear_attribution", "stream_session_tally", "csv_roundtrip",
                                  "log_lifecycle", "metrics_roundtrip", "series_windows", "class_view", "knn_minority",
                                  "voice_features", "dfa", "shimmer", "sampling_shapley", "average_rank"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    oc = [d[0] for d in cur.description]
    assert sorted(oc) == cols
    exp = sorted("|".join(_norm(dict(zip(oc, r))[c]) for c in cols) for r in cur.fetchall())
    assert got == exp
