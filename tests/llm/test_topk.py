import math
import random

import pytest
from pyspark.sql import functions as F

from voxlab.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, norm double"


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4.0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect())


def f32(x):
    import numpy as np
    return float(np.float32(x))


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr("voxlab.llm.topk.GROUP", 64)
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(600):
        c, s = rnd.choice(centres), math.exp(rnd.gauss(0, spread)) / 4
        rows.append((i, [f32(s * (x + rnd.gauss(0, 0.2))) for x in c]))
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # many equal vectors
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]),
            (7, [-1.0, -2.0]), (8, [1.0, 2.0, 3.0]), (100, []), (None, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(i, [float(2 ** 20 + i), 3.0]) for i in range(0, 120)]
    assert run(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (3, [2.0])]) == [(0, 1, 3, 131072)]
