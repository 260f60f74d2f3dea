"""Joins: band range join, parameter broadcast, name lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.scalar import round_half_even

BANDS_SCHEMA = T.StructType([
    T.StructField("lo", T.IntegerType(), False), T.StructField("hi", T.IntegerType(), False),
    T.StructField("label", T.StringType(), False), T.StructField("color", T.StringType(), False),
    T.StructField("page_color", T.StringType(), False), T.StructField("page_bg", T.StringType(), False),
])

# A band table of known size up to this is broadcast; others are joined by cells of this width.
MAX_BAND_ROWS = 10_000
BAND_CELL = 16


def bands_table(spark: SparkSession) -> DataFrame:
    from ..sources.io import literal_rows
    return literal_rows(spark, [tuple(b) for b in C.SEVERITY_BANDS], BANDS_SCHEMA)


def band_join(df: DataFrame, score: str, bands: DataFrame | None = None, rounding: str | None = "half_even",
              out: str = "band", color: str | None = "band_color", n_bands: int | None = None) -> DataFrame:
    """Range join score -> band: ``lo <= s <= hi`` on closed integer ranges.

    ``rounding=None``: training rule, raw score (10.4 falls into the 10..11
    gap and gets the fallback band); ``"half_even"``: serving rule
    (``bround``).  Unmatched rows get the fallback band.  The table is
    broadcast only when its size is known to be small (``n_bands``, or the
    built-in table); otherwise scores and bands meet by cells of the score.
    """
    spark = df.sparkSession
    if bands is None:
        bands = bands_table(spark)
        n_bands = len(C.SEVERITY_BANDS)
    s = F.col(score)
    if rounding == "half_even":
        s = round_half_even(s, 0)
    elif rounding == "half_up":
        s = F.round(s, 0)
    b = bands.select(F.col("lo").alias("_vx_lo"), F.col("hi").alias("_vx_hi"),
                     F.col("label").alias("_vx_label"), F.col("color").alias("_vx_color"))
    inside = (s >= F.col("_vx_lo")) & (s <= F.col("_vx_hi"))
    if n_bands is not None and n_bands <= MAX_BAND_ROWS:
        j = df.join(F.broadcast(b), inside, "left")
    else:  # any number of bands: an equi-join on cells that a band is listed under
        at = b.withColumn("_vx_cell", F.explode(F.sequence(F.floor(F.col("_vx_lo") / BAND_CELL), F.floor(F.col("_vx_hi") / BAND_CELL))))
        j = df.join(at, (F.floor(s / BAND_CELL) == F.col("_vx_cell")) & inside, "left").drop("_vx_cell")
    fb = [x for x in C.SEVERITY_BANDS if x[2] == C.FALLBACK_BAND][0]
    cols = {out: F.coalesce(F.col("_vx_label"), F.lit(fb[2]))}
    if color:
        cols[color] = F.coalesce(F.col("_vx_color"), F.lit(fb[3]))
    return j.withColumns(cols).drop("_vx_lo", "_vx_hi", "_vx_label", "_vx_color")


def scaler_params(params) -> dict:
    """Fitted scaler constants as a dict (a one-row frame is fetched; its size
    is 2 x the number of features, whatever the data size)."""
    if isinstance(params, dict):
        return params
    rows = params.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("scaler parameters must be exactly one row")
    return rows[0].asDict()


def apply_scaler(df: DataFrame, params, feats: Sequence[str], suffix: str = "") -> DataFrame:
    """Standardise ``feats`` with fitted parameters (``mu_<f>``, ``sd_<f>``).

    Like a fitted Spark ML model, the constants live on the driver and enter
    the plan as literals, so the transform is one codegen projection with no
    join and no subquery.
    """
    p = scaler_params(params)
    return df.withColumns({f + suffix: (F.col(f"`{f}`") - F.lit(float(p[f"mu_{f}"]))) / F.lit(float(p[f"sd_{f}"]))
                           for f in feats})


def name_lookup(df: DataFrame, idx: str, names: Sequence[str], out: str = "feature") -> DataFrame:
    """Feature index -> name (a literal array; no join needed)."""
    return df.withColumn(out, F.element_at(F.array(*[F.lit(n) for n in names]), F.col(idx) + 1))
