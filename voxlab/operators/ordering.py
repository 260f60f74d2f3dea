"""Exact order statistics without a single-task window.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends a whole group ``g`` to
one task; with no ``g`` at all it sends the whole table to one task.  The
helpers here give the *same* numbers at scale:

1. a bucket column that never decreases along ``k`` splits every group into
   many pieces (hash prefix, index block, log-spaced value range);
2. a window runs only inside ``(g, bucket)``;
3. bucket totals -- one row per non-empty bucket, bounded by the bucket
   scheme rather than by the data -- give each bucket its offset.

The bucket totals table is joined back on ``(g, bucket)``; that join shares its
hash partitioning with the inner window, so the whole thing costs one shuffle
of the data plus one of the small totals table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_vx_bucket"
_G = "_vx_group"


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def md5_key(seed, keys: Sequence[str | Column]) -> Column:
    """md5 hex of ``'seed|k1|k2…'`` -- equal in Spark and DuckDB."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hex_bucket(hex_col: Column, digits: int = 3) -> Column:
    """Leading ``digits`` hex characters as an int (4,096 buckets for 3)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")


def block_bucket(idx: Column, width: int = 4096) -> Column:
    """Integer index split into fixed blocks (dense series indexes)."""
    return F.floor(idx / F.lit(width)).cast("long")


def value_bucket(x: Column, per_octave: int = 256) -> Column:
    """Log-spaced bucket of a double that never decreases with ``x``.

    Buckets are ``2**(1/per_octave)`` wide in relative terms, so their number
    is bounded by the double range (about 2 x 2,100 x ``per_octave``), not by
    the data.  NaN goes to the top bucket (Spark orders NaN above all), nulls
    to the bottom.
    """
    a = F.abs(x)
    mag = F.floor(F.log2(a) * F.lit(per_octave)) + F.lit(1100 * per_octave)
    return (F.when(x.isNull(), F.lit(-(1 << 40)))
            .when(F.isnan(x), F.lit(1 << 40))
            .when(a < F.lit(1e-300), F.lit(0))
            .when(x > 0, mag)
            .otherwise(-mag)).cast("long")


def refined_bucket(df: DataFrame, by, key: Column, coarse: int, fine: int, limit: int = 1_000_000,
                   out: str = "_vx_rb") -> DataFrame:
    """Adds a bucket column ``(key div coarse, key div fine or 0)``.

    Coarse buckets holding more than ``limit`` rows of a group are split into
    ``fine`` ones; the pair never decreases along ``key``, so it can drive
    ``prefix_sums`` / ``exact_rank``.  The hot-bucket table has at most
    rows / ``limit`` rows and is joined on ``(group, coarse bucket)``.
    """
    by = _cols(by)
    c = df.withColumn("_vx_cb", F.floor(key / F.lit(coarse)).cast("long")).withColumn("_vx_key", key)
    hot = c.groupBy(*by, "_vx_cb").agg(F.count(F.lit(1)).alias("_vx_cn")).where(F.col("_vx_cn") > limit) \
        .select(*by, "_vx_cb", F.lit(1).alias("_vx_hot"))
    c = c.join(hot, [*by, "_vx_cb"], "left")
    sub = F.when(F.col("_vx_hot") == 1, F.floor(F.col("_vx_key") / F.lit(fine))).otherwise(F.lit(0)).cast("long")
    return c.withColumn(out, F.struct(F.col("_vx_cb").alias("c"), sub.alias("f"))).drop("_vx_cb", "_vx_hot", "_vx_key")


def prefix_sums(df: DataFrame, by, order, bucket: Column, values: dict[str, Column],
                inclusive: bool = True, totals: bool = False) -> DataFrame:
    """Running sums of ``values`` along ``order`` within ``by`` groups.

    Exact equivalent of ``sum(v) OVER (PARTITION BY by ORDER BY order ROWS
    BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)`` (or ``1 PRECEDING`` when
    ``inclusive`` is False).  ``order`` must be a total order inside a group
    for the result to be deterministic.  With ``totals`` the group totals are
    added as ``<name>_total``.

    The bucket totals are aggregated from the windowed rows themselves (already
    partitioned by ``(by, bucket)``), so the input is shuffled once.
    """
    by, order = _cols(by), _cols(order)
    # a struct is never null, so null groups and buckets meet themselves in the join, as they do in a window
    b = df.withColumns({_G: F.struct(*by) if by else F.struct(F.lit(0)), _B: F.struct(bucket)})
    for name, v in values.items():
        b = b.withColumn(f"_vx_v_{name}", v)
    inner = Window.partitionBy(_G, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b
    for name in values:
        local = local.withColumn(f"_vx_l_{name}", F.coalesce(F.sum(f"_vx_v_{name}").over(inner), F.lit(0)))
    offs = local.groupBy(_G, _B).agg(*[F.sum(f"_vx_v_{n}").alias(f"_vx_n_{n}") for n in values])
    outer = Window.partitionBy(_G).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    for name in values:
        offs = offs.withColumn(f"_vx_o_{name}", F.coalesce(F.sum(f"_vx_n_{name}").over(outer), F.lit(0)))
        if totals:
            offs = offs.withColumn(f"{name}_total", F.sum(f"_vx_n_{name}").over(Window.partitionBy(_G)))
    keep = [_G, _B] + [f"_vx_o_{n}" for n in values] + ([f"{n}_total" for n in values] if totals else [])
    out = local.join(offs.select(*keep), on=[_G, _B], how="inner")
    for name in values:
        run = F.col(f"_vx_o_{name}") + F.col(f"_vx_l_{name}")
        if not inclusive:
            run = run - F.coalesce(F.col(f"_vx_v_{name}"), F.lit(0))
        out = out.withColumn(name, run)
    return out.drop(_G, _B, *[f"_vx_{p}_{n}" for n in values for p in ("v", "l", "o")])


def exact_rank(df: DataFrame, by, order, bucket: Column, out: str = "rank",
               totals: bool = False) -> DataFrame:
    """``row_number() OVER (PARTITION BY by ORDER BY order)`` computed by buckets."""
    r = prefix_sums(df, by, order, bucket, {out: F.lit(1).cast("long")}, inclusive=True, totals=totals)
    return r


def exact_percentiles(df: DataFrame, by, value: str, probs: Sequence[float],
                      per_octave: int = 4096) -> DataFrame:
    """Exact percentiles with linear interpolation (numpy / DuckDB ``quantile_cont``).

    Returns one row per group and probability: ``(*by, p, value)``.  Nulls
    are ignored.  Plan:

    1. ``(group, value) -> count`` with map-side partial aggregation, so
       heavily repeated values collapse before any shuffle;
    2. running counts over the distinct values by log-spaced value buckets
       (``prefix_sums``): a distinct value covers positions
       ``[cum - count, cum)``;
    3. each needed position finds its bucket in the bounded bucket-offset
       table, then its value by an equi-join on ``(group, bucket)``.

    No task ever holds a whole group.
    """
    names = _cols(by)
    by = ["_vx_by"]  # never null, so null groups keep their percentiles
    x = F.col(value).cast("double")
    df = df.withColumn("_vx_by", F.struct(*names) if names else F.struct(F.lit(0)))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, x.alias("_vx_x")).agg(F.count(F.lit(1)).alias("_vx_c"))
    counts = counts.withColumn(_B, value_bucket(F.col("_vx_x"), per_octave))
    cum = prefix_sums(counts, by, ["_vx_x"], F.col(_B), {"_vx_cum": F.col("_vx_c")}, inclusive=True, totals=True)
    cum = cum.withColumn(_B, value_bucket(F.col("_vx_x"), per_octave))
    # bucket table: [start, end) positions of each bucket (bounded per group)
    bt = cum.groupBy(*by, _B).agg(F.min(F.col("_vx_cum") - F.col("_vx_c")).alias("_vx_bs"),
                                  F.max("_vx_cum").alias("_vx_be"), F.first("_vx_cum_total").alias("_vx_n"))
    n = F.col("_vx_n")
    tgt = bt.select(*by, "_vx_n").distinct().select(*by, F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("p"),
                 F.floor(F.lit(float(p)) * (n - 1)).cast("long").alias("lo"),
                 (F.lit(float(p)) * (n - 1) - F.floor(F.lit(float(p)) * (n - 1))).alias("frac"))
        for p in probs])).alias("t")).select(*by, "t.p", "t.lo", "t.frac")
    need = tgt.select(*by, "p", "frac", F.explode(F.array(
        F.struct(F.col("lo").alias("_vx_pos"), F.lit(0).alias("which")),
        F.struct(F.least(F.col("lo") + 1, F.col("lo")).alias("_vx_pos"), F.lit(1).alias("which")))).alias("k")) \
        .select(*by, "p", "frac", "k._vx_pos", "k.which")
    # the upper neighbour only matters when frac > 0; it is position lo + 1
    need = need.withColumn("_vx_pos", F.when(F.col("which") == 1, F.col("_vx_pos") + F.when(F.col("frac") > 0, 1).otherwise(0))
                           .otherwise(F.col("_vx_pos")))
    located = need.join(bt, by).where((F.col("_vx_pos") >= F.col("_vx_bs")) & (F.col("_vx_pos") < F.col("_vx_be"))) \
        .select(*by, "p", "frac", "which", "_vx_pos", _B)
    hit = located.join(cum.select(*by, _B, "_vx_x", "_vx_c", "_vx_cum"), [*by, _B]) \
        .where((F.col("_vx_pos") >= F.col("_vx_cum") - F.col("_vx_c")) & (F.col("_vx_pos") < F.col("_vx_cum")))
    agg = hit.groupBy(*by, "p", "frac").agg(
        F.max(F.when(F.col("which") == 0, F.col("_vx_x"))).alias("_lo_v"),
        F.max(F.when(F.col("which") == 1, F.col("_vx_x"))).alias("_hi_v"))
    val = (F.when(F.col("frac") > 0, F.col("_lo_v") + F.col("frac") * (F.col("_hi_v") - F.col("_lo_v")))
           .otherwise(F.col("_lo_v")))
    return agg.select(*[F.col(f"_vx_by.`{c}`").alias(c) for c in names], "p", val.alias("value"))
