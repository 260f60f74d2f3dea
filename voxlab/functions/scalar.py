"""Scalar column functions: guards, clipping, rounding, bands, tiers, formats.

All are ``pyspark.sql.functions`` compositions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

__all__ = [
    "col_", "safe_log", "clip", "guarded_reciprocal", "round_half_even", "safe_number",
    "to_percent", "complement", "confidence", "risk_tier", "direction", "target_size",
    "fmt_percent", "fmt_points", "log_time", "file_stamp", "clip_severity", "sigmoid",
    "when_enough", "band_case",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_log(x, eps: float = 0.0) -> Column:
    """Natural log with an additive guard (``log(x + eps)``)."""
    x = col_(x)
    return F.log(x + F.lit(eps)) if eps else F.log(x)


def clip(x, lo: float, hi: float) -> Column:
    """Clip to ``[lo, hi]``; NaN and null stay as they are.

    ``least`` treats NaN as the largest value, so NaN is guarded first.
    """
    x = col_(x)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def guarded_reciprocal(x, eps: float = 1e-6) -> Column:
    return F.lit(1.0) / (col_(x) + F.lit(eps))


def round_half_even(x, digits: int = 0) -> Column:
    return F.bround(col_(x), digits)


def safe_number(x) -> Column:
    """null, NaN, non-numeric text and 0 -> 0.0; otherwise the double value."""
    v = (F.col(f"`{x}`") if isinstance(x, str) else x).try_cast("double")
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) + F.lit(0.0)


def to_percent(x) -> Column:
    return col_(x) * F.lit(100.0)


def complement(p) -> Column:
    return F.lit(1.0) - col_(p)


def confidence(p0, p1) -> Column:
    """Larger of the two class probabilities."""
    return F.greatest(col_(p0), col_(p1))


def risk_tier(pct, amber: float = C.RISK_AMBER, red: float = C.RISK_RED) -> Column:
    """Percent -> 'red' (>= red), 'amber' (>= amber), else 'green'."""
    pct = col_(pct)
    return F.when(pct >= red, "red").when(pct >= amber, "amber").otherwise("green")


def direction(v) -> Column:
    v = col_(v)
    return F.when(v > 0, C.DIRECTION_POSITIVE).otherwise(C.DIRECTION_NEGATIVE)


def target_size(n, ratio: float = C.OVERSAMPLE_RATIO) -> Column:
    """``int(n * ratio)`` (truncation)."""
    return F.floor(col_(n) * F.lit(ratio)).cast("long")


def fmt_percent(x, digits: int = 1) -> Column:
    """``0.123 -> '12.3%'``."""
    return F.format_string(f"%.{digits}f%%", col_(x) * F.lit(100.0))


def fmt_points(p, threshold: float = 0.5) -> Column:
    """Signed points over ``threshold``, e.g. ``'+12.3pp'``; null when ``p <= threshold``."""
    p = col_(p)
    return F.when(p > threshold, F.format_string("%+.1fpp", (p - F.lit(threshold)) * F.lit(100.0)))


def log_time(ts) -> Column:
    return F.date_format(col_(ts), "HH:mm:ss")


def file_stamp(ts) -> Column:
    return F.date_format(col_(ts), "yyyyMMdd_HHmm")


def clip_severity(x, lo: float = C.SEVERITY_CLIP[0], hi: float = C.SEVERITY_CLIP[1]) -> Column:
    return clip(x, lo, hi)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(x)))


def when_enough(n, k: int, expr: Column, default) -> Column:
    """``expr`` only when ``n > k``, else the constant ``default``."""
    return F.when(col_(n) > F.lit(k), expr).otherwise(F.lit(default))


def band_case(score, rounding: str | None = "half_even", what: str = "label") -> Column:
    """Severity band as a CASE expression (no join needed for the fixed table).

    ``rounding=None`` is the training rule (raw score; gaps fall to the
    fallback band), ``"half_even"`` the serving rule.
    """
    s = col_(score)
    if rounding == "half_even":
        s = F.bround(s, 0)
    elif rounding == "half_up":
        s = F.round(s, 0)
    idx = {"label": 2, "color": 3, "page_color": 4, "page_bg": 5}[what]
    expr = None
    for band in C.SEVERITY_BANDS:
        cond = (s >= F.lit(band[0])) & (s <= F.lit(band[1]))
        expr = F.when(cond, F.lit(band[idx])) if expr is None else expr.when(cond, F.lit(band[idx]))
    fb = [b for b in C.SEVERITY_BANDS if b[2] == C.FALLBACK_BAND][0][idx]
    return expr.otherwise(F.lit(fb))
