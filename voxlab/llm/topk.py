"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers and grouped by length.  The longest vectors,
a fixed number of them, are searched first; a query's k-th best score there is
a floor for its final one.  For every bucket of lengths in [lo, hi] the floor
is a local cosine threshold t = floor / (|q| hi): the bucket is passed over
when t > 1; when t is at least ``COORDINATE_FROM`` the rows are pruned by the
range that a cosine of t leaves to the query's largest coordinates; below it
by length alone, as only vectors of length >= floor / |q| can reach the floor.
What is left is verified by its integer product.

A bucket is dealt out in sub-buckets of about ``GROUP`` rows by a hash of the
id, so equal lengths spread, and the queries in blocks of about ``GROUP``; a
query goes to the sub-buckets its floor doesn't rule out, and each returns at
most k rows for it.  Memory is bounded by one sub-bucket and one block.

Defined results: vectors null or holding null or non-finite components take no
part; a query with fewer than k candidates gets all; ties go to the smaller
id; rows that carry the query's id are its own and no candidates, other rows
that share an id are a candidate each; an id of null takes no part; an empty table gives an empty result.
Vectors of different lengths meet on their common number of components only if
equal, others never meet.  Components beyond +-2^23 are multiplied as Python
integers; a score beyond long raises an error rather than a wrong rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

GROUP, QUERY_BLOCK, BUCKETS = 8192, 512, 32
COORDINATE_FROM, COORDINATES = 0.25, 4
NO_FLOOR = -(1 << 63)


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of long), dim, norm of the vectors that take part."""
    v = F.col(vec_col)
    fit = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v")) \
        .withColumns({"dim": F.size("v"), "norm": norm})


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no partial sum leaves 2^53, else as Python integers."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if big < 2.0 ** 52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return np.array([[int(x) for x in row] for row in q.astype(object) @ c.astype(object).T], dtype=np.int64).reshape(len(q), len(c))


def _search(row, q_ids, q, q_norm, floor, ids, c, norms, k):
    """(query row, query, candidate, score): holding each query's k best of one sub-bucket at least as good as its floor."""
    out = []
    order = np.argsort(-norms, kind="stable")
    ids, c, norms = ids[order], c[order], norms[order]
    unit = c / np.maximum(norms, 1e-300)[:, None]
    for a in range(0, len(q), QUERY_BLOCK):
        qs, qn, fl = q[a:a + QUERY_BLOCK], q_norm[a:a + QUERY_BLOCK], floor[a:a + QUERY_BLOCK]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(fl > 0, fl / (qn * norms[0]), -1.0) * (1 - 1e-9)
            need = np.where(fl > 0, fl / qn, 0.0) * (1 - 1e-9)
        length = np.searchsorted(-norms, -need, side="right")  # rows long enough; they come first
        for i in np.flatnonzero((t >= COORDINATE_FROM) & (t <= 1)):
            n = length[i]
            # a cosine of s >= t leaves each coordinate of the unit vector within qi s +- sqrt((1 - qi^2)(1 - s^2))
            u, keep = qs[i] / qn[i], np.ones(n, bool)
            s = np.minimum(1.0, fl[i] * (1 - 1e-9) / (qn[i] * norms[:n]))
            for f in np.argsort(-np.abs(u))[:COORDINATES]:
                x = abs(u[f])
                low = x * s - np.sqrt(max(0.0, 1 - x * x) * (1 - s * s))
                keep &= np.where(s >= 0, unit[:n, f] * np.sign(u[f] or 1) >= low - 1e-9, True)
            rows = np.flatnonzero(keep)
            _best(out, row[a + i], q_ids[a + i], fl[i], ids[rows], _products(qs[i:i + 1], c[rows])[0], k)
        plain = np.flatnonzero(t < COORDINATE_FROM)
        if len(plain):
            n = int(length[plain].max())
            scores = _products(qs[plain], c[:n])
            for j, i in enumerate(plain):
                _best(out, row[a + i], q_ids[a + i], fl[i], ids[:length[i]], scores[j, :length[i]], k)
    return out


def _best(out: list, row, qid, floor, ids, scores, k: int) -> None:
    keep = np.flatnonzero((ids != qid) & (scores >= floor))
    if len(keep) > k:
        least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= least]
    best = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    out.extend((int(row), int(qid), int(i), int(s)) for i, s in zip(ids[best], scores[best], strict=True))


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return pc.list_flatten(col).to_numpy().reshape(len(col), dim)


def _searcher(k: int):
    def run(key: tuple, parts: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["_q", "query_id", "vec_id", "score"]
        if not len(parts) or not len(queries):
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        dim = key[1].as_py()
        floor = pc.fill_null(queries["floor"], NO_FLOOR).to_numpy()
        found = _search(queries["_q"].to_numpy(), queries["query_id"].to_numpy(), _matrix(queries["v"], dim), queries["q_norm"].to_numpy(), floor,
                        parts["vec_id"].to_numpy(), _matrix(parts["v"], dim), parts["norm"].to_numpy(), k)
        return pa.table([pa.array([r[i] for r in found], pa.int64()) for i in range(4)], names=names)
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "_q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _met(parts: DataFrame, queries: DataFrame, buckets: DataFrame, blocks: int, k: int) -> DataFrame:
    """Each query's k best of every sub-bucket of ``buckets`` that its floor doesn't rule out.

    A pair of a sub-bucket and a block of queries is one group; both have a bounded number of rows.
    """
    floor = F.col("floor") * (1 - 1e-9)
    sent = queries.join(buckets, "dim").where(F.col("floor").isNull() | (floor <= 0) | (floor <= F.col("q_norm") * F.col("hi"))) \
        .withColumns({"sub": F.explode(F.sequence(F.lit(0), F.col("subs") - 1)), "block": F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int")})
    rows = parts.join(buckets.select("bucket", "dim"), ["bucket", "dim"], "left_semi") \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["bucket", "dim", "sub", "block"]
    return rows.groupBy(*keys).cogroup(sent.select(*keys, "_q", "query_id", "v", "q_norm", "floor").groupBy(*keys)) \
        .applyInArrow(_searcher(k), "_q long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer products with the other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    v = stage(quantised(vectors, id_col=id_col, vec_col=vec_col), "vectors")
    # lengths that cut the rows into buckets of about equal numbers
    cuts = sorted(set(v.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.005)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("norm"))) if cuts else F.lit(0)
    rows = v.withColumn("bucket", bucket.cast("int"))
    buckets = rows.groupBy("bucket", "dim").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("subs"), F.max("norm").alias("hi"))
    buckets = stage(buckets, "buckets")  # at most BUCKETS rows per number of components
    parts = rows.join(buckets.select("bucket", "dim", "subs"), ["bucket", "dim"]) \
        .withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int"))
    parts = stage(parts.select("bucket", "dim", "sub", "vec_id", "v", "norm"), "parts")
    queries = stage(v.where(is_query).select(F.monotonically_increasing_id().alias("_q"), F.col("vec_id").alias("query_id"), "v", "dim",
                                             F.col("norm").alias("q_norm")), "queries")
    blocks = max(1, -(-queries.count() // GROUP))
    longest = buckets.groupBy("dim").agg(F.max("bucket").alias("bucket"))
    first = _met(parts, queries.withColumn("floor", F.lit(None).cast("long")), buckets.join(longest, ["dim", "bucket"]), blocks, k)
    first = stage(_ranked(first, k), "first")
    floor = first.where(F.col("rank") == k).select("_q", F.col("score").alias("floor"))
    later = _met(parts, queries.join(floor, "_q", "left"), buckets.join(longest, ["dim", "bucket"], "left_anti"), blocks, k)
    return _ranked(first.drop("rank").unionByName(later), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
