"""Exact, reproducible splits, folds and samples.

All picks are driven by ``md5('seed|key')`` so the same rows come out in
Spark and in an independent SQL engine, and the positions are exact
bucketed ranks (no window over a whole class).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .ordering import exact_rank, hex_bucket, md5_key

#: Classes up to which a split is a condition on the md5.
CUT_CLASSES = 100


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def hash_rank(df: DataFrame, keys, by: Sequence[str] = (), seed: int = C.SEED, out: str = "_vx_rank",
              totals: bool = True) -> DataFrame:
    """1-based position in md5 order inside ``by`` (ties broken by the keys)."""
    k = _keys(keys)
    # 65,536 md5 buckets: a class of 10^11 rows leaves ~1.5M rows per window task
    bucket = hex_bucket(md5_key(seed, k), 4)
    # dealt as the windows need them before the md5 text is made, which would be most of the shuffle
    h = df.repartition(*([F.struct(*by)] if by else []), F.struct(bucket)).withColumn("_vx_h", md5_key(seed, k))
    return exact_rank(h, list(by), ["_vx_h", *k], hex_bucket(F.col("_vx_h"), 4), out=out, totals=totals)


def hash_cuts(df: DataFrame, keys, y: str, test: float, seed: int = C.SEED) -> list[tuple] | None:
    """``(class, md5 text)`` of the last of the first ``round(test * n_class)`` rows in md5 order, for classes with such rows.

    Rows are counted by class and md5 bucket, then only the buckets that hold the cuts are sorted.  None if rows of
    one md5 stand on both sides of a cut, or there are more than ``CUT_CLASSES`` classes.
    """
    k = _keys(keys)
    h = df.select(F.col(y).alias("_y"), md5_key(seed, k).alias("_h")).withColumn("_b", hex_bucket(F.col("_h"), 4))
    n = h.groupBy("_y", "_b").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy("_y")
    n = n.withColumns({"_cum": F.sum("_c").over(own.orderBy("_b")), "_n": F.round(F.lit(test) * F.sum("_c").over(own))})
    at = n.where((F.col("_cum") >= F.col("_n")) & (F.col("_cum") - F.col("_c") < F.col("_n"))) \
        .select(F.col("_y").alias("_ay"), F.col("_b").alias("_ab"), (F.col("_n") - F.col("_cum") + F.col("_c")).alias("_need")).limit(CUT_CLASSES + 1)
    at = h.sparkSession.createDataFrame(at.collect(), at.schema)
    near = h.join(F.broadcast(at), F.col("_y").eqNullSafe(F.col("_ay")) & (F.col("_b") == F.col("_ab")))
    near = near.groupBy("_y", "_need", "_h").agg(F.count(F.lit(1)).alias("_c"))
    near = near.withColumn("_cum", F.sum("_c").over(own.orderBy("_h")))
    found = near.where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_c") < F.col("_need"))).select("_y", "_h", "_cum", "_need").collect()
    if len(found) > CUT_CLASSES or any(r["_cum"] > r["_need"] for r in found):
        return None
    return [(r["_y"], r["_h"]) for r in found]


def split_stratified(df: DataFrame, keys, y: str = "status", test: float = C.TEST_FRACTION,
                     seed: int = C.SEED, out: str = "is_test", written: bool = False) -> DataFrame:
    """Disjoint split; inside each class the first ``round(test * n_class)``
    rows in md5 order are the test rows.

    Rows of a ``written`` table, cheap to read again, aren't shuffled: two passes find each class's last md5."""
    cuts = hash_cuts(df, keys, y, test, seed) if written else None
    if cuts is not None:
        h, is_test = md5_key(seed, _keys(keys)), F.lit(False)
        for c, last in cuts:
            is_test = is_test | (F.col(y).eqNullSafe(F.lit(c).cast(df.schema[y].dataType)) & (h <= F.lit(last)))
        return df.withColumn(out, is_test)
    r = hash_rank(df, keys, [y], seed)
    return r.withColumn(out, F.col("_vx_rank") <= F.round(F.lit(test) * F.col("_vx_rank_total"))) \
            .drop("_vx_h", "_vx_rank", "_vx_rank_total")


def split_plain(df: DataFrame, keys, test: float = C.TEST_FRACTION, seed: int = C.SEED,
                out: str = "is_test", group_col: str | None = None) -> DataFrame:
    """Disjoint split over the whole set (no strata).

    With ``group_col`` whole groups (e.g. subjects) go to one side: the first
    ``round(test * n_groups)`` groups in md5 order are test.
    """
    if group_col is None:
        r = hash_rank(df, keys, [], seed)
        return r.withColumn(out, F.col("_vx_rank") <= F.round(F.lit(test) * F.col("_vx_rank_total"))) \
                .drop("_vx_h", "_vx_rank", "_vx_rank_total")
    g = df.select(group_col).distinct()
    gr = hash_rank(g, [group_col], [], seed)
    gr = gr.select(group_col, (F.col("_vx_rank") <= F.round(F.lit(test) * F.col("_vx_rank_total"))).alias(out))
    return df.join(gr, group_col)


def assign_folds(df: DataFrame, keys, y: str | None = None, k: int = C.CV_FOLDS, seed: int = C.SEED,
                 out: str = "fold") -> DataFrame:
    """Fold number 0..k-1 per row: position in md5 order (per class when
    stratified) modulo k, so every class is spread evenly."""
    r = hash_rank(df, keys, [y] if y else [], seed, totals=False)
    return r.withColumn(out, ((F.col("_vx_rank") - 1) % k).cast("int")).drop("_vx_h", "_vx_rank")


def background_sample(df: DataFrame, keys, n: int = C.BACKGROUND_ROWS, seed: int = C.SEED) -> DataFrame:
    """First ``n`` rows in md5 order (a top-n: each task keeps at most n rows)."""
    k = _keys(keys)
    return df.withColumn("_vx_h", md5_key(seed, k)).orderBy("_vx_h", *k).limit(n).drop("_vx_h")


def _u32(seed, tag: str, j) -> "F.Column":
    """Unsigned 32-bit draw from md5('seed|tag|j') (same in Spark and DuckDB)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), j.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def smote(df: DataFrame, key: str, feats: Sequence[str], y: str = "status", minority=0, majority=1,
          ratio: float = C.OVERSAMPLE_RATIO, k: int = C.SMOTE_K, seed: int = C.SEED,
          num_partitions: int | None = None) -> DataFrame:
    """Synthetic minority rows by interpolation with a nearest neighbour.

    Target minority size = int(ratio * majority count); ``target - minority``
    new rows j = 0, 1, ... are made.  Row j takes parent = minority row at
    md5 position (draw_p(j) mod n_min) + 1, neighbour = its
    (draw_n(j) mod k')-th nearest other minority row (k' = min(k, n_min - 1)),
    u = draw_u(j) / 2^32, and features x + u (nn - x).  Draws are md5-based
    so results are reproducible across engines.  Returns only the new rows:
    ``(syn_id, parent_<key>, nn_<key>, y, feats…)``.
    """
    from .neighbours import knn_self
    feats = list(feats)
    counts = df.agg(F.count_if(F.col(y) == minority).alias("n_min"),
                    F.count_if(F.col(y) == majority).alias("n_maj")).first()
    n_min, n_maj = int(counts["n_min"]), int(counts["n_maj"])
    target = int(n_maj * ratio)
    n_new = target - n_min
    spark = df.sparkSession
    schema_cols = ["syn_id", f"parent_{key}", f"nn_{key}", y] + feats
    if n_new <= 0 or n_min < 2:
        return spark.createDataFrame([], ", ".join([f"syn_id long, parent_{key} long, nn_{key} long, {y} int"] +
                                                   [f"`{f}` double" for f in feats]))
    kk = min(k, n_min - 1)
    mino = df.where(F.col(y) == minority).select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in feats])
    # the minority rows feed several jobs (ranking, principal directions,
    # neighbour bounds, parents): written once to the shared folder
    from ..session import cut_lineage
    mino = cut_lineage(hash_rank(mino, key, [], seed, out="_rk", totals=False).drop("_vx_h"))
    syn = spark.range(0, n_new, numPartitions=num_partitions or max(1, min(n_new // 100_000 + 1, 10_000)))
    j = F.col("id")
    syn = syn.select(j.alias("syn_id"),
                     (F.pmod(_u32(seed, "p", j), F.lit(n_min)) + 1).alias("_rk"),
                     (F.pmod(_u32(seed, "n", j), F.lit(kk)) + 1).alias("pos"),
                     (_u32(seed, "u", j).cast("double") / F.lit(4294967296.0)).alias("_u"))
    par = mino.select(F.col(key).alias(f"parent_{key}"), "_rk", *[F.col(f).alias(f"p__{f}") for f in feats])
    # neighbours are needed only for the parents actually drawn
    parents = syn.select("_rk").distinct().join(mino.select(key, "_rk"), "_rk").select(key)
    nn = knn_self(mino, key, feats, k=kk, order_key="_rk", query_keys=parents)
    out = syn.join(par, "_rk")
    out = out.join(nn.select(F.col(key).alias(f"parent_{key}"), "pos", f"nn_{key}"), [f"parent_{key}", "pos"])
    nb = mino.select(F.col(key).alias(f"nn_{key}"), *[F.col(f).alias(f"n__{f}") for f in feats])
    out = out.join(nb, f"nn_{key}")
    return out.select("syn_id", f"parent_{key}", f"nn_{key}", F.lit(minority).cast("int").alias(y),
                      *[(F.col(f"p__{f}") + F.col("_u") * (F.col(f"n__{f}") - F.col(f"p__{f}"))).alias(f) for f in feats])
