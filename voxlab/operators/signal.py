"""Ordered-series voice measures over long tables keyed by recording.

Inputs are long tables -- ``frames(recording_id, frame_idx, f0[, r])``,
``pulses(recording_id, pulse_idx, t, amp)``, ``samples(recording_id,
sample_idx, value)`` -- never arrays, so one recording may be as large as
the cluster allows:

* positions are exact bucketed ranks (``ordering.exact_rank``), not a
  window over the whole recording;
* neighbour access (lag, lead, centred means, delay vectors) is a stencil:
  each row is copied to the few positions that need it and regrouped on
  ``(recording_id, position)``, which hash-partitions a long recording over
  all tasks;
* running sums use bucketed prefix sums;
* per-recording results are partial aggregates.

Measures (defaults and guards as in the screening application):
f0 mean / max / min, spread1, spread2, RPDE, PPE (density entropy of an
equal-width histogram), DFA, D2 (see ``correlation``), jitter (local,
absolute, RAP, PPQ5, DDP), shimmer (local, dB, APQ3, APQ5, APQ11, DDA),
HNR / NHR, silence trimming.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalar import clip, guarded_reciprocal, safe_log, when_enough
from .ordering import block_bucket, exact_percentiles, exact_rank, prefix_sums
from .project import voiced

REC = "recording_id"


# ---------------------------------------------------------------------------
# building blocks
# ---------------------------------------------------------------------------

def dense_index(df: DataFrame, order: str, rec: str = REC, out: str = "i") -> DataFrame:
    """0-based dense position along an integer ``order`` column inside ``rec``."""
    r = exact_rank(df, [rec], [order], block_bucket(F.col(order)), out="_vx_pos")
    return r.withColumn(out, F.col("_vx_pos") - 1).drop("_vx_pos")


BLOCK = 4096


def stencil(df: DataFrame, cols: Sequence[str], offsets: Sequence[int], rec: str = REC, i: str = "i",
            keep: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Neighbour values as columns: ``<c>_<o>`` = value of ``c`` at ``i + o``.

    Positions are cut into blocks of ``BLOCK``; only rows within reach of an edge
    are copied to the next block, so about 1 + reach / BLOCK copies are
    shuffled and a long recording is spread over all tasks.  One sort per block
    serves all offsets.  Missing neighbours are null; offsets stay below BLOCK.
    ``dense``: positions are those of ``dense_index`` (none missing or twice), so
    a neighbour is that many rows away.
    """
    offs = sorted({0, *offsets})
    at = lambda d: block_bucket(F.col(i) - F.lit(d), BLOCK)
    rows = df.select(rec, i, *cols, *keep, F.explode(F.array_distinct(F.array(at(offs[-1]), at(0), at(offs[0])))).alias("_vx_blk"))
    w = Window.partitionBy(rec, "_vx_blk").orderBy(i)
    if dense:
        near = {f"{c}_{_tag(o)}": F.lead(c, o).over(w) if o else F.col(c) for o in offs for c in cols}
    else:
        near = {f"{c}_{_tag(o)}": F.max(c).over(w.rangeBetween(o, o)) for o in offs for c in cols}
    return rows.withColumns(near).where(F.col("_vx_blk") == at(0)).select(rec, i, *near, *keep)


#: Parts that a recording's rows are dealt in where they meet its constants.
PARTS = 32


def with_constants(df: DataFrame, constants: DataFrame, rec: str = REC) -> DataFrame:
    """Inner join of rows with one row per recording.

    The constants are repeated for each of ``PARTS`` parts and rows meet
    them by ``(recording, part)``, the part a hash of the row, so a recording
    that holds a large share of all rows is split.
    """
    parts = constants.withColumn("_vx_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    own = F.pmod(F.xxhash64(*[c for c in df.columns if c != rec] or [rec]), F.lit(PARTS)).cast("int")
    return df.withColumn("_vx_part", own).join(parts, [rec, "_vx_part"]).drop("_vx_part")


def _tag(o: int) -> str:
    return f"p{o}" if o >= 0 else f"m{-o}"


def recordings(df: DataFrame, rec: str = REC) -> DataFrame:
    return df.select(rec).distinct()


def voiced_series(frames: DataFrame, f0: str = "f0", order: str = "frame_idx", rec: str = REC) -> DataFrame:
    """Voiced frames with a dense 0-based index ``i`` over voiced frames only."""
    v = voiced(frames, f0).select(rec, order, F.col(f0).cast("double").alias("x"))
    return dense_index(v, order, rec)


def ranked_voiced(frames: DataFrame, f0: str = "f0", order: str = "frame_idx", rec: str = REC) -> DataFrame:
    """``voiced_series`` whose rows carry their recording's number of voiced frames ``n``, mean ``mu``
    and range ``lo``, ``hi``, met once for all measures that need them."""
    v = voiced_series(frames, f0, order, rec)
    st = voiced(frames, f0).select(rec, F.col(f0).cast("double").alias("x")).groupBy(rec).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mu"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return with_constants(v, st, rec)


def lag_diff(df: DataFrame, x: str, rec: str = REC, i: str = "i", out: str | None = None) -> DataFrame:
    """``x_i - x_{i-1}`` along the dense index (null for the first row)."""
    s = stencil(df, [x], [-1], rec, i)
    return s.select(rec, i, F.col(f"{x}_p0").alias(x), (F.col(f"{x}_p0") - F.col(f"{x}_m1")).alias(out or f"{x}_diff"))


def centred_mean(df: DataFrame, x: str, width: int, rec: str = REC, i: str = "i", out: str | None = None) -> DataFrame:
    """Centred moving mean over ``width`` (odd) points; only full frames."""
    h = width // 2
    s = stencil(df, [x], [o for o in range(-h, h + 1) if o != 0], rec, i)
    parts = [F.col(f"{x}_{_tag(o)}") for o in range(-h, h + 1)]
    full = F.lit(True)
    for c in parts:
        full = full & c.isNotNull()
    m = sum(parts[1:], parts[0]) / float(width)
    return s.where(full).select(rec, i, F.col(f"{x}_p0").alias(x), m.alias(out or f"{x}_mean{width}"))


def segment(df: DataFrame, s, n_col: str = "n", i: str = "i") -> DataFrame:
    """Segment ``i div s`` and in-segment index ``i mod s``; segments start
    at 0, s, 2s, ... while start < n - s (an exact final segment is lost).
    ``s`` is an int or a column."""
    s = F.lit(s) if isinstance(s, int) else s
    seg = F.floor(F.col(i) / s)
    return df.withColumns({"seg": seg, "k": F.col(i) % s}).where(seg * s < F.col(n_col) - s)


def minmax(df: DataFrame, x: str, rec: str = REC, eps: float = 1e-6, out: str | None = None) -> DataFrame:
    """``(x - min) / ((max - min) + eps)`` inside each group (group
    extremes by partial aggregation, joined back)."""
    st = df.groupBy(rec).agg(F.min(x).alias("_vx_mn"), F.max(x).alias("_vx_mx"))
    return with_constants(df, st, rec).withColumn(out or f"{x}_norm", (F.col(x) - F.col("_vx_mn")) /
                                       ((F.col("_vx_mx") - F.col("_vx_mn")) + F.lit(eps))).drop("_vx_mn", "_vx_mx")


def over_max(df: DataFrame, x: str, rec: str = REC, out: str | None = None) -> DataFrame:
    """``x / max(x)`` inside each group (null when the maximum is 0)."""
    st = df.groupBy(rec).agg(F.max(x).alias("_vx_mx"))
    return with_constants(df, st, rec).withColumn(out or f"{x}_share", F.try_divide(F.col(x), F.col("_vx_mx"))).drop("_vx_mx")


# ---------------------------------------------------------------------------
# f0 summary and spreads
# ---------------------------------------------------------------------------

def f0_summary(frames: DataFrame, f0: str = "f0", rec: str = REC) -> DataFrame:
    """Mean / max / min of voiced f0 per recording; 0.0 when nothing is voiced."""
    v = voiced(frames, f0).groupBy(rec).agg(F.avg(f0).alias("f0_mean"), F.max(f0).alias("f0_max"),
                                            F.min(f0).alias("f0_min"), F.count(F.lit(1)).alias("n_voiced"))
    out = recordings(frames, rec).join(v, rec, "left")
    return out.select(rec, *[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c)
                             for c in ("f0_mean", "f0_max", "f0_min")],
                      F.coalesce(F.col("n_voiced"), F.lit(0)).alias("n_voiced"))


def spreads(frames: DataFrame, f0: str = "f0", rec: str = REC) -> DataFrame:
    """spread1 = clip(-ln(|p25 - p75| + 1e-6), -8, -2), -5 if n <= 4;
    spread2 = std_pop / (mean + 1e-6), 0.2 if n <= 4."""
    v = voiced(frames, f0).select(rec, F.col(f0).cast("double").alias("x"))
    basic = v.groupBy(rec).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sd"), F.avg("x").alias("mu"))
    q = exact_percentiles(v, [rec], "x", [0.25, 0.75]).groupBy(rec).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("p25"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("p75"))
    j = recordings(frames, rec).join(basic, rec, "left").join(q, rec, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    s1 = clip(-safe_log(F.abs(F.col("p25") - F.col("p75")), 1e-6), -8.0, -2.0)
    s2 = F.col("sd") / (F.col("mu") + F.lit(1e-6))
    return j.select(rec, when_enough(n, 4, s1, C.DEFAULT_SPREAD1).alias("spread1"),
                    when_enough(n, 4, s2, C.DEFAULT_SPREAD2).alias("spread2"))


# ---------------------------------------------------------------------------
# Histogram density and normalised entropy
# ---------------------------------------------------------------------------

def histogram_density(df: DataFrame, x: str, rec: str = REC, max_bins: int = C.HIST_MAX_BINS, known: bool = False) -> DataFrame:
    """Equal-width histogram per group with density values.

    bins = min(max_bins, n div 2) over [min, max]; the last bin is closed on
    the right; a zero-width range is widened to [v - 0.5, v + 0.5].  Bin
    edges are ``lo + k * (hi - lo) / bins`` (last edge = hi) and a value's bin
    is the scaled index corrected against those edges, so values lying on an
    edge fall exactly where numpy puts them.  density = count / width / n.
    Output ``(rec, bin, count, density, n, bins)``.  ``known``: the rows carry
    their group's size ``n`` and the extremes ``lo``, ``hi`` of ``x``.
    """
    st = df.select(rec, F.col(x).alias("_vx_x"), "n", "lo", "hi") if known else \
        df.groupBy(rec).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    st = st.withColumn("bins", F.least(F.lit(max_bins), F.floor(F.col("n") / 2)).cast("int"))
    st = st.withColumns({
        "lo_e": F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5),
        "hi_e": F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5)})
    st = st.withColumn("step", (F.col("hi_e") - F.col("lo_e")) / F.col("bins"))
    if known:
        j = st.where(F.col("bins") > 0)
    else:
        spread = [F.col(c).alias("_vx_at") for c in ("frame_idx", "i") if c in df.columns][:1]
        j = with_constants(df.select(rec, F.col(x).alias("_vx_x"), *spread), st.where(F.col("bins") > 0), rec)
    bins, lo_e, hi_e, step, v = F.col("bins"), F.col("lo_e"), F.col("hi_e"), F.col("step"), F.col("_vx_x")

    def edge(k):
        return F.when(k == bins, hi_e).otherwise(k.cast("double") * step + lo_e)

    i0 = F.least(F.floor(((v - lo_e) / (hi_e - lo_e)) * bins), bins - 1).cast("int")
    j = j.withColumn("_vx_i", i0)
    i1 = F.when(v < edge(F.col("_vx_i")), F.col("_vx_i") - 1).otherwise(F.col("_vx_i"))
    j = j.withColumn("_vx_i", i1)
    i2 = F.when((v >= edge(F.col("_vx_i") + 1)) & (F.col("_vx_i") != bins - 1), F.col("_vx_i") + 1).otherwise(F.col("_vx_i"))
    j = j.withColumn("bin", i2)
    h = j.groupBy(rec, "bin").agg(F.count(F.lit(1)).alias("count"), F.first("n").alias("n"), F.first("bins").alias("bins"),
                                  F.first("lo_e").alias("lo_e"), F.first("hi_e").alias("hi_e"), F.first("step").alias("step"))
    bins, lo_e, hi_e, step = F.col("bins"), F.col("lo_e"), F.col("hi_e"), F.col("step")
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    return h.select(rec, "bin", "count", (F.col("count") / width / F.col("n")).alias("density"), "n", "bins")


def density_entropy(hist: DataFrame, rec: str = REC) -> DataFrame:
    """clip(-sum(h ln(h + 1e-12)) / (ln(#non-empty bins) + 1e-12), 0, 1)."""
    e = hist.where(F.col("density") > 0).groupBy(rec).agg(
        (-F.sum(F.col("density") * safe_log(F.col("density"), 1e-12))).alias("h"),
        F.count(F.lit(1)).alias("k"))
    return e.select(rec, clip(F.col("h") / (F.log(F.col("k").cast("double")) + F.lit(1e-12)), 0.0, 1.0).alias("entropy"))


def _index(df: DataFrame) -> list[str]:
    return [c for c in ("frame_idx",) if c in df.columns]


def rpde(frames: DataFrame, f0: str = "f0", rec: str = REC, series: DataFrame | None = None) -> DataFrame:
    """Normalised density entropy of voiced f0; 0.5 when n <= 10.  ``series``: ``ranked_voiced`` of the frames."""
    v = series if series is not None else voiced(frames, f0).select(rec, F.col(f0).cast("double").alias("x"), *_index(frames))
    n = v.groupBy(rec).agg(F.count(F.lit(1)).alias("n"))
    ent = density_entropy(histogram_density(v, "x", rec, known=series is not None), rec)
    j = recordings(frames, rec).join(n, rec, "left").join(ent, rec, "left")
    return j.select(rec, when_enough(F.coalesce(F.col("n"), F.lit(0)), 10, F.col("entropy"), C.DEFAULT_RPDE).alias("RPDE"))


def ppe(frames: DataFrame, f0: str = "f0", rec: str = REC, series: DataFrame | None = None) -> DataFrame:
    """Entropy of min-max normalised periods 1/(f0 + 1e-6); 0.2 when n <= 10.  ``series``: ``ranked_voiced`` of the frames."""
    norm = lambda p: (p - F.col("pmin")) / ((F.col("pmax") - F.col("pmin")) + F.lit(1e-6))
    if series is not None:
        # periods fall as f0 rises, so the range of f0 gives theirs
        v = series.select(rec, "n", *[guarded_reciprocal(F.col(c), 1e-6).alias(p) for c, p in (("x", "period"), ("hi", "pmin"), ("lo", "pmax"))])
        n = v.groupBy(rec).agg(F.count(F.lit(1)).alias("n"))
        pn = v.select(rec, "n", *[norm(F.col(p)).alias(c) for p, c in (("period", "pn"), ("pmin", "lo"), ("pmax", "hi"))])
    else:
        v = voiced(frames, f0).select(rec, guarded_reciprocal(F.col(f0).cast("double"), 1e-6).alias("period"), *_index(frames))
        st = v.groupBy(rec).agg(F.count(F.lit(1)).alias("n"), F.min("period").alias("pmin"), F.max("period").alias("pmax"))
        n = st.select(rec, "n")
        pn = with_constants(v, st, rec).select(rec, norm(F.col("period")).alias("pn"), *_index(v))
    ent = density_entropy(histogram_density(pn, "pn", rec, known=series is not None), rec)
    j = recordings(frames, rec).join(n, rec, "left").join(ent, rec, "left")
    return j.select(rec, when_enough(F.coalesce(F.col("n"), F.lit(0)), 10, F.col("entropy"), C.DEFAULT_PPE).alias("PPE"))


# ---------------------------------------------------------------------------
# Detrended fluctuation analysis
# ---------------------------------------------------------------------------

def geometric_scales(length: Column, lo: int = C.DFA_MIN_SCALE, num: int = C.DFA_SCALES) -> Column:
    """Distinct ascending integer scales from ``lo`` to ``length div 4``.

    Same arithmetic as a log10-spaced geometric sequence truncated to int;
    first and last points pinned to the exact end values.
    """
    hi = F.floor(length / 4).cast("double")
    a = F.log10(F.lit(float(lo)))
    b = F.log10(hi)
    step = (b - a) / F.lit(float(num - 1))
    pts = [F.lit(lo)] + [F.pow(F.lit(10.0), F.lit(float(k)) * step + a).cast("int") for k in range(1, num - 1)] \
        + [hi.cast("int")]
    return F.array_distinct(F.array(*[p.cast("int") for p in pts]))


def dfa_signal(frames: DataFrame, samples: DataFrame | None = None, f0: str = "f0",
               rec: str = REC, series: DataFrame | None = None) -> DataFrame:
    """Series used by DFA: voiced f0 when a recording has more than 20 voiced
    frames, else its first 2,000 raw samples.  Output ``(rec, i, x)``.
    ``series``: an already ranked voiced series ``(rec, i, x)``; where it is that of
    ``ranked_voiced`` and there are no samples, its ``n`` and ``mu`` are kept."""
    if samples is None and series is not None and {"n", "mu"} <= set(series.columns):
        return series.where((F.col("n") > 20) & F.col(rec).isNotNull()).select(rec, "i", "x", "n", "mu")
    v = (series if series is not None else voiced_series(frames, f0, rec=rec)).select(rec, "i", "x")
    nv = v.groupBy(rec).agg(F.count(F.lit(1)).alias("_vx_nv"))
    long_v = with_constants(v, nv.where(F.col("_vx_nv") > 20), rec).select(rec, "i", "x")
    if samples is None:
        return long_v
    # the raw samples of the few short recordings alone are ranked
    short = recordings(frames, rec).join(nv.where(F.col("_vx_nv") > 20), rec, "left_anti")
    own = with_constants(samples.select(rec, "sample_idx", F.col("value").cast("double").alias("x")), short, rec)
    s = dense_index(own, "sample_idx", rec).where(F.col("i") < C.DFA_RAW_FALLBACK)
    return long_v.unionByName(s.select(rec, "i", "x"))


def dfa(signal: DataFrame, rec: str = REC, all_recordings: DataFrame | None = None) -> DataFrame:
    """DFA exponent per recording from a dense series ``(rec, i, x)``.

    Centred running sum y; scales from ``geometric_scales(L)``; segments of
    length s start at 0, s, 2s, ... while start < L - s; per segment the RMS
    of the least-squares line residual; mean RMS per scale; slope of
    ln(F + 1e-12) on ln(s), clipped to [0.3, 0.95]; 0.6 when L <= 20 or
    fewer than 3 scales.
    """
    # mean and length ride along the running sum; one join brings them where they don't come with the signal
    if {"n", "mu"} <= set(signal.columns):
        c = signal.withColumnRenamed("n", "L").where(F.col("L") > 20)
    else:
        st = signal.groupBy(rec).agg(F.count(F.lit(1)).alias("L"), F.avg("x").alias("mu"))
        c = with_constants(signal, st.where(F.col("L") > 20), rec)
    c = c.withColumn("_vx_d", F.col("x") - F.col("mu"))
    y = prefix_sums(c, [rec], ["i"], block_bucket(F.col("i")), {"y": F.col("_vx_d")}).withColumn("scales", geometric_scales(F.col("L")))
    seg = y.select(rec, "i", "y", "L", F.explode("scales").alias("s"))
    seg = segment(seg, F.col("s"), "L").withColumn("k", F.col("k").cast("double"))
    per = seg.groupBy(rec, "s", "seg").agg(
        F.regr_sxx("y", "k").alias("sxx"), F.regr_sxy("y", "k").alias("sxy"), F.regr_syy("y", "k").alias("syy"),
        F.count(F.lit(1)).alias("m"))
    rss = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    per = per.withColumn("rms", F.sqrt(rss / F.col("m")))
    fl = per.groupBy(rec, "s").agg(F.avg("rms").alias("fluct"))
    fit = fl.groupBy(rec).agg(
        F.regr_slope(F.log(F.col("fluct") + F.lit(1e-12)), F.log(F.col("s").cast("double"))).alias("slope"),
        F.count(F.lit(1)).alias("n_scales"))
    base = all_recordings if all_recordings is not None else recordings(signal, rec)
    j = base.join(fit, rec, "left")
    return j.select(rec, F.when(F.col("n_scales") > 2, clip(F.col("slope"), 0.3, 0.95))
                    .otherwise(F.lit(C.DEFAULT_DFA)).alias("DFA"))


# ---------------------------------------------------------------------------
# Jitter and shimmer
# ---------------------------------------------------------------------------

def _ratio_ok(a: Column, b: Column, limit: float) -> Column:
    """max/min of two positives within ``limit``; an undefined ratio (a zero) is not ok."""
    return F.coalesce(F.try_divide(F.greatest(a, b), F.least(a, b)) <= F.lit(limit), F.lit(False))


def periods(pulses: DataFrame, rec: str = REC) -> DataFrame:
    """Pulse positions -> periods ``T_j = t_{j+1} - t_j`` with amplitudes
    ``a0 = amp_j``, ``a1 = amp_{j+1}`` (dense ``j``)."""
    p = dense_index(pulses.select(rec, "pulse_idx", "t", "amp"), "pulse_idx", rec)
    s = stencil(p, ["t", "amp"], [0, 1], rec)
    return s.where(F.col("t_p1").isNotNull()).select(
        rec, "i", (F.col("t_p1") - F.col("t_p0")).alias("T"), F.col("amp_p0").alias("a0"), F.col("amp_p1").alias("a1"))


def jitter(pulses: DataFrame, t_min: float = C.JITTER_T_MIN, t_max: float = C.JITTER_T_MAX,
           max_ratio: float = C.JITTER_MAX_RATIO, rec: str = REC) -> DataFrame:
    """Jitter per recording over the period series T_j.

    A term uses periods inside [t_min, t_max] whose consecutive ratios are
    at most ``max_ratio``; missing terms are skipped.  local = mean|T_j -
    T_{j-1}| / mean T; absolute = the numerator; RAP / PPQ5 = mean|T_j -
    centred mean of 3 / 5| / mean T; DDP = 3 RAP.  Mean T is over periods
    inside the limits.  All 0.0 when nothing qualifies.
    """
    p = dense_index(pulses.select(rec, "pulse_idx", "t"), "pulse_idx", rec)
    agg = stencil(p, ["t"], range(-2, 4), rec, dense=True).groupBy(rec).agg(*_jitter_terms(t_min, t_max, max_ratio))
    return recordings(pulses, rec).join(agg, rec, "left").select(rec, *_jitter_values())


def _jitter_terms(t_min: float, t_max: float, max_ratio: float) -> list[Column]:
    """The sums of ``jitter`` over pulse times at j - 2 .. j + 3."""
    t = {o: F.col(f"t_{_tag(o + 1)}") - F.col(f"t_{_tag(o)}") for o in (-2, -1, 0, 1, 2)}  # the period from pulse j + o on
    ok = {o: p.isNotNull() & p.between(t_min, t_max) for o, p in t.items()}
    rat = {(o, o + 1): _ratio_ok(t[o], t[o + 1], max_ratio) for o in (-2, -1, 0, 1)}
    loc_ok = ok[-1] & ok[0] & rat[(-1, 0)]
    rap_ok = ok[-1] & ok[0] & ok[1] & rat[(-1, 0)] & rat[(0, 1)]
    ppq_ok = rap_ok & ok[-2] & ok[2] & rat[(-2, -1)] & rat[(1, 2)]
    return [
        F.avg(F.when(ok[0], t[0])).alias("mean_T"),
        F.avg(F.when(loc_ok, F.abs(t[0] - t[-1]))).alias("abs_"),
        F.avg(F.when(rap_ok, F.abs(t[0] - (t[-1] + t[0] + t[1]) / 3.0))).alias("rap_"),
        F.avg(F.when(ppq_ok, F.abs(t[0] - (t[-2] + t[-1] + t[0] + t[1] + t[2]) / 5.0))).alias("ppq_")]


def _or_zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def _jitter_values() -> list[Column]:
    return [_or_zero(F.col("abs_") / F.col("mean_T")).alias("jitter_local"),
            _or_zero(F.col("abs_")).alias("jitter_abs"),
            _or_zero(F.col("rap_") / F.col("mean_T")).alias("jitter_rap"),
            _or_zero(F.col("ppq_") / F.col("mean_T")).alias("jitter_ppq5"),
            _or_zero(F.lit(3.0) * F.col("rap_") / F.col("mean_T")).alias("jitter_ddp")]


def shimmer(pulses: DataFrame, t_min: float = C.JITTER_T_MIN, t_max: float = C.JITTER_T_MAX,
            max_ratio: float = C.JITTER_MAX_RATIO, max_amp_ratio: float = C.SHIMMER_MAX_AMP_RATIO,
            rec: str = REC) -> DataFrame:
    """Shimmer per recording over pulse amplitudes A_j.

    A term centred on pulse j with half-width h uses the pulses j-h..j+h;
    every period between them must be inside [t_min, t_max], consecutive
    period ratios at most ``max_ratio`` and consecutive amplitude ratios at
    most ``max_amp_ratio``.  local = mean|A_j - A_{j-1}| / mean A; dB =
    mean|20 log10(A_j / A_{j-1})|; APQ3/5/11 = mean|A_j - centred mean| /
    mean A; DDA = 3 APQ3.  mean A is over all pulses.  0.0 when nothing
    qualifies.
    """
    p = dense_index(pulses.select(rec, "pulse_idx", "t", "amp"), "pulse_idx", rec)
    agg = stencil(p, ["t", "amp"], SHIMMER_REACH, rec, dense=True).groupBy(rec).agg(*_shimmer_terms(t_min, t_max, max_ratio, max_amp_ratio))
    return recordings(pulses, rec).join(agg, rec, "left").select(rec, *_shimmer_values())


#: Pulses around one that its shimmer terms read; those of jitter are among them.
SHIMMER_REACH = range(-5, 7)


def _shimmer_terms(t_min: float, t_max: float, max_ratio: float, max_amp_ratio: float) -> list[Column]:
    """The sums of ``shimmer`` over pulses at j - 5 .. j + 6."""
    offs = SHIMMER_REACH
    t = {o: F.col(f"t_{_tag(o)}") for o in offs}
    a = {o: F.col(f"amp_{_tag(o)}") for o in offs}
    per = {o: t[o + 1] - t[o] for o in range(-5, 6)}  # period between pulse o and o+1
    per_ok = {o: t[o].isNotNull() & t[o + 1].isNotNull() & per[o].between(t_min, t_max) for o in range(-5, 6)}

    def window_ok(lo: int, hi: int) -> Column:
        c = F.lit(True)
        for o in range(lo, hi):
            c = c & per_ok[o] & _ratio_ok(a[o], a[o + 1], max_amp_ratio)
        for o in range(lo, hi - 1):
            c = c & _ratio_ok(per[o], per[o + 1], max_ratio)
        return c

    def apq(h: int) -> Column:
        m = sum((a[o] for o in range(-h, h + 1)), F.lit(0.0)) / float(2 * h + 1)
        return F.avg(F.when(window_ok(-h, h), F.abs(a[0] - m)))

    return [
        F.avg(a[0]).alias("mean_A"),
        F.avg(F.when(window_ok(-1, 0), F.abs(a[0] - a[-1]))).alias("loc_"),
        F.avg(F.when(window_ok(-1, 0), F.abs(F.lit(20.0) * F.log10(F.try_divide(a[0], a[-1]))))).alias("db_"),
        apq(1).alias("apq3_"), apq(2).alias("apq5_"), apq(5).alias("apq11_")]


def _shimmer_values() -> list[Column]:
    return [_or_zero(F.col("loc_") / F.col("mean_A")).alias("shimmer_local"),
            _or_zero(F.col("db_")).alias("shimmer_db"),
            _or_zero(F.col("apq3_") / F.col("mean_A")).alias("shimmer_apq3"),
            _or_zero(F.col("apq5_") / F.col("mean_A")).alias("shimmer_apq5"),
            _or_zero(F.col("apq11_") / F.col("mean_A")).alias("shimmer_apq11"),
            _or_zero(F.lit(3.0) * F.col("apq3_") / F.col("mean_A")).alias("shimmer_dda")]


def jitter_shimmer(pulses: DataFrame, t_min: float = C.JITTER_T_MIN, t_max: float = C.JITTER_T_MAX, max_ratio: float = C.JITTER_MAX_RATIO,
                   max_amp_ratio: float = C.SHIMMER_MAX_AMP_RATIO, rec: str = REC) -> DataFrame:
    """``jitter`` and ``shimmer`` of every recording that has an id, from one ranking and one stencil."""
    p = dense_index(pulses.where(F.col(rec).isNotNull()).select(rec, "pulse_idx", "t", "amp"), "pulse_idx", rec)
    agg = stencil(p, ["t", "amp"], SHIMMER_REACH, rec, dense=True).groupBy(rec).agg(
        *_jitter_terms(t_min, t_max, max_ratio), *_shimmer_terms(t_min, t_max, max_ratio, max_amp_ratio))
    return agg.select(rec, *_jitter_values(), *_shimmer_values())


# ---------------------------------------------------------------------------
# harmonicity
# ---------------------------------------------------------------------------

def harmonicity(frames: DataFrame, r: str = "r", f0: str = "f0", rec: str = REC) -> DataFrame:
    """HNR = mean 10 log10(r / (1 - r)) over voiced frames with 0 < r < 1;
    NHR = 1 / (HNR + 1e-6) if HNR > 0 else 0.1.  HNR 0.0 when undefined."""
    v = voiced(frames, f0).where((F.col(r) > 0) & (F.col(r) < 1))
    h = v.groupBy(rec).agg(F.avg(F.lit(10.0) * F.log10(F.col(r) / (F.lit(1.0) - F.col(r)))).alias("h"))
    j = recordings(frames, rec).join(h, rec, "left")
    hnr = F.coalesce(F.nanvl(F.col("h"), F.lit(0.0)), F.lit(0.0))
    return j.select(rec, hnr.alias("HNR"),
                    F.when(hnr > 0, guarded_reciprocal(hnr, 1e-6)).otherwise(F.lit(C.DEFAULT_NHR)).alias("NHR"))


# ---------------------------------------------------------------------------
# Silence trimming
# ---------------------------------------------------------------------------

def trim_silence(samples: DataFrame, top_db: float = 60.0, frame: int = 2048, rec: str = REC) -> DataFrame:
    """Keep samples from the first to the last loud frame of each recording.

    Frames are consecutive blocks of ``frame`` samples (by dense position);
    frame level = RMS; a frame is loud when 20 log10(rms / max rms) >
    -top_db.  Threshold and frame length are explicit arguments.
    """
    s = dense_index(samples, "sample_idx", rec)
    s = s.withColumn("_vx_f", F.floor(F.col("i") / frame))
    fr = s.groupBy(rec, "_vx_f").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    mx = fr.groupBy(rec).agg(F.max("rms").alias("mx"))
    level = F.lit(20.0) * F.log10(F.try_divide(F.col("rms"), F.col("mx")))
    loud = with_constants(fr, mx, rec).where((F.col("mx") > 0) & F.coalesce(level > -top_db, F.lit(False)))
    span = loud.groupBy(rec).agg(F.min("_vx_f").alias("f_lo"), F.max("_vx_f").alias("f_hi"))
    return with_constants(s, span, rec).where(F.col("_vx_f").between(F.col("f_lo"), F.col("f_hi"))) \
        .drop("_vx_f", "f_lo", "f_hi")
