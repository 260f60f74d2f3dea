"""Signal-measure queries on the series stand-ins (``events`` per user).

frames:  recording = user_id, frame = position by (ts, event_id), f0 = value,
         r = value / (value + 50)
pulses:  t = running sum of 0.004 + value / 1e5, amp = value
samples: value = (f0 - 250) / 250 (for silence trimming)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import signal as SG
from ..operators.correlation import correlation_dimension, delay_vectors
from ..sources.tables import series_frames, series_pulses

REC = SG.REC
R6 = lambda c: F.round(F.col(c), 6).alias(c)


def frames_r(spark, sf):
    fr = series_frames(spark, sf)
    return fr.withColumn("r", F.col("f0") / (F.col("f0") + F.lit(50.0)))


def q_f0_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = SG.f0_summary(series_frames(spark, sf))
    return s.select(REC, F.round("f0_mean", 4).alias("f0_mean"), R6("f0_max"), R6("f0_min"), "n_voiced")


def q_spreads(spark: SparkSession, sf: str) -> DataFrame:
    return SG.spreads(series_frames(spark, sf)).select(REC, R6("spread1"), R6("spread2"))


def q_rpde(spark: SparkSession, sf: str) -> DataFrame:
    return SG.rpde(series_frames(spark, sf)).select(REC, R6("RPDE"))


def q_ppe(spark: SparkSession, sf: str) -> DataFrame:
    return SG.ppe(series_frames(spark, sf)).select(REC, R6("PPE"))


def q_dfa(spark: SparkSession, sf: str) -> DataFrame:
    fr = series_frames(spark, sf)
    return SG.dfa(SG.dfa_signal(fr), all_recordings=SG.recordings(fr)).select(REC, F.round("DFA", 5).alias("DFA"))


def q_jitter(spark: SparkSession, sf: str) -> DataFrame:
    j = SG.jitter(series_pulses(spark, sf))
    return j.select(REC, *[F.round(F.col(c), 9).alias(c) for c in j.columns if c != REC])


def q_shimmer(spark: SparkSession, sf: str) -> DataFrame:
    s = SG.shimmer(series_pulses(spark, sf))
    return s.select(REC, *[F.round(F.col(c), 6).alias(c) for c in s.columns if c != REC])


def q_harmonicity(spark: SparkSession, sf: str) -> DataFrame:
    return SG.harmonicity(frames_r(spark, sf)).select(REC, R6("HNR"), R6("NHR"))


def q_correlation_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return correlation_dimension(series_frames(spark, sf)).select(REC, R6("D2"))


def q_delay_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return delay_vectors(series_frames(spark, sf)).select(REC, "i", "x0", "x1", "x2")


def samples_of(spark, sf):
    fr = series_frames(spark, sf)
    return fr.select(REC, F.col("frame_idx").alias("sample_idx"), ((F.col("f0") - 250.0) / 250.0).alias("value"))


def q_trim_silence(spark: SparkSession, sf: str) -> DataFrame:
    t = SG.trim_silence(samples_of(spark, sf), top_db=20.0, frame=8)
    return t.groupBy(REC).agg(F.count(F.lit(1)).alias("kept"), F.min("sample_idx").alias("first_idx"),
                              F.max("sample_idx").alias("last_idx"))


# --- SQL oracle pieces --------------------------------------------------------

FRAMES = """frames AS (
  SELECT user_id AS recording_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_idx,
         CAST(value AS DOUBLE) AS f0, value / (value + 50.0) AS r
  FROM events),
recs AS (SELECT DISTINCT recording_id FROM frames),
vf AS (SELECT recording_id, frame_idx, f0 AS x,
              row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1 AS i
       FROM frames WHERE f0 > 0 AND NOT isnan(f0)),
nv AS (SELECT recording_id, count(*) AS n FROM vf GROUP BY 1)"""

PULSES = """pl AS (
  SELECT recording_id, frame_idx - 1 AS i, f0 AS amp,
         sum(0.004 + f0 / 100000.0) OVER (PARTITION BY recording_id ORDER BY frame_idx
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t
  FROM frames)"""

SQL_F0_SUMMARY = "WITH " + FRAMES + """
SELECT r.recording_id, round(coalesce(a.m, 0.0), 4) AS f0_mean, round(coalesce(a.mx, 0.0), 6) AS f0_max,
       round(coalesce(a.mn, 0.0), 6) AS f0_min, coalesce(a.n, 0) AS n_voiced
FROM recs r LEFT JOIN (SELECT recording_id, avg(x) m, max(x) mx, min(x) mn, count(*) n FROM vf GROUP BY 1) a USING (recording_id)"""

SQL_SPREADS = "WITH " + FRAMES + """,
a AS (SELECT recording_id, count(*) n, stddev_pop(x) sd, avg(x) mu,
             quantile_cont(x, 0.25) p25, quantile_cont(x, 0.75) p75 FROM vf GROUP BY 1)
SELECT r.recording_id,
       round(CASE WHEN coalesce(n, 0) > 4 THEN greatest(-8.0, least(-2.0, -ln(abs(p25 - p75) + 1e-6))) ELSE -5.0 END, 6) AS spread1,
       round(CASE WHEN coalesce(n, 0) > 4 THEN sd / (mu + 1e-6) ELSE 0.2 END, 6) AS spread2
FROM recs r LEFT JOIN a USING (recording_id)"""


def _entropy_sql(src: str, col: str, default: float, out: str) -> str:
    def edge(k):
        return f"(CASE WHEN {k} = bins THEN hi_e ELSE CAST({k} AS DOUBLE) * step + lo_e END)"
    return f"""
st_{out} AS (SELECT recording_id, count(*) n, min({col}) lo, max({col}) hi FROM {src} GROUP BY 1),
st2_{out} AS (SELECT *, (hi_e - lo_e) / bins AS step FROM (
                SELECT *, least(20, n // 2) AS bins,
                       CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END AS lo_e,
                       CASE WHEN hi > lo THEN hi ELSE hi + 0.5 END AS hi_e FROM st_{out})),
b0_{out} AS (SELECT s.recording_id, {col} AS v, bins, lo_e, hi_e, step, n,
                    CAST(least(floor((({col} - lo_e) / (hi_e - lo_e)) * bins), bins - 1) AS INTEGER) AS i0
             FROM {src} s JOIN st2_{out} USING (recording_id) WHERE bins > 0),
b1_{out} AS (SELECT *, CASE WHEN v < {edge('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM b0_{out}),
b2_{out} AS (SELECT *, CASE WHEN v >= {edge('(i1 + 1)')} AND i1 <> bins - 1 THEN i1 + 1 ELSE i1 END AS bin FROM b1_{out}),
hb_{out} AS (SELECT recording_id, bin, count(*) AS c, any_value(n) AS n, any_value(bins) AS bins,
                    any_value(lo_e) AS lo_e, any_value(hi_e) AS hi_e, any_value(step) AS step
             FROM b2_{out} GROUP BY 1, 2),
de_{out} AS (SELECT recording_id, c / ({edge('(bin + 1)')} - {edge('bin')}) / n AS h FROM hb_{out}),
en_{out} AS (SELECT recording_id, -sum(h * ln(h + 1e-12)) AS hh, count(*) AS k FROM de_{out} WHERE h > 0 GROUP BY 1),
res_{out} AS (
  SELECT r.recording_id,
         CASE WHEN coalesce(st.n, 0) > 10 THEN greatest(0.0, least(1.0, hh / (ln(k) + 1e-12))) ELSE {default} END AS {out}
  FROM recs r LEFT JOIN st_{out} st USING (recording_id) LEFT JOIN en_{out} USING (recording_id))"""


SQL_RPDE = "WITH " + FRAMES + "," + _entropy_sql("vf", "x", C.DEFAULT_RPDE, "RPDE") + \
    "\nSELECT recording_id, round(RPDE, 6) AS RPDE FROM res_RPDE"

PERIODS_SQL = """
per AS (SELECT recording_id, 1.0 / (x + 1e-6) AS period FROM vf),
pst AS (SELECT recording_id, min(period) pmin, max(period) pmax FROM per GROUP BY 1),
pn AS (SELECT recording_id, (period - pmin) / ((pmax - pmin) + 1e-6) AS pn FROM per JOIN pst USING (recording_id))"""

SQL_PPE = "WITH " + FRAMES + "," + PERIODS_SQL + "," + _entropy_sql("pn", "pn", C.DEFAULT_PPE, "PPE") + \
    "\nSELECT recording_id, round(PPE, 6) AS PPE FROM res_PPE"

DFA_SQL = """
sig AS (SELECT vf.recording_id, i, x FROM vf JOIN nv USING (recording_id) WHERE n > 20),
dst AS (SELECT recording_id, count(*) AS L, avg(x) AS mu FROM sig GROUP BY 1),
cs AS (SELECT s.recording_id, i, sum(x - mu) OVER (PARTITION BY s.recording_id ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM sig s JOIN dst USING (recording_id)),
sc0 AS (SELECT recording_id, L, k, CAST(floor(L / 4) AS DOUBLE) AS hi FROM dst, range(12) t(k)),
sc AS (SELECT DISTINCT recording_id, L,
              CASE WHEN k = 0 THEN 4 WHEN k = 11 THEN CAST(trunc(hi) AS INTEGER)
                   ELSE CAST(trunc(pow(10.0, k * ((log10(hi) - log10(4.0)) / 11.0) + log10(4.0))) AS INTEGER) END AS s
       FROM sc0),
sg AS (SELECT cs.recording_id, sc.s, i // sc.s AS seg, CAST(i % sc.s AS DOUBLE) AS kk, y
       FROM cs JOIN sc USING (recording_id) WHERE (i // sc.s) * sc.s < sc.L - sc.s),
ps AS (SELECT recording_id, s, seg, regr_sxx(y, kk) sxx, regr_sxy(y, kk) sxy, regr_syy(y, kk) syy, count(*) m
       FROM sg GROUP BY 1, 2, 3),
fl AS (SELECT recording_id, s, avg(sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / m)) AS fluct FROM ps GROUP BY 1, 2),
ft AS (SELECT recording_id, regr_slope(ln(fluct + 1e-12), ln(CAST(s AS DOUBLE))) AS slope, count(*) AS ns FROM fl GROUP BY 1)"""

SQL_DFA = "WITH " + FRAMES + "," + DFA_SQL + """
SELECT r.recording_id, round(CASE WHEN ns > 2 THEN greatest(0.3, least(0.95, slope)) ELSE 0.6 END, 5) AS DFA
FROM recs r LEFT JOIN ft USING (recording_id)"""


def _jitter_sql() -> str:
    lo, hi, mr = C.JITTER_T_MIN, C.JITTER_T_MAX, C.JITTER_MAX_RATIO
    def ok(c):
        return f"({c} IS NOT NULL AND {c} BETWEEN {lo} AND {hi})"
    def rat(a, b):
        return f"(greatest({a}, {b}) / least({a}, {b}) <= {mr})"
    loc = f"{ok('tm1')} AND {ok('t0')} AND {rat('tm1', 't0')}"
    rap = f"{ok('tm1')} AND {ok('t0')} AND {ok('tp1')} AND {rat('tm1', 't0')} AND {rat('t0', 'tp1')}"
    ppq = f"{rap} AND {ok('tm2')} AND {ok('tp2')} AND {rat('tm2', 'tm1')} AND {rat('tp1', 'tp2')}"
    return "WITH " + FRAMES + "," + PULSES + """,
pe AS (SELECT recording_id, i, lead(t) OVER (PARTITION BY recording_id ORDER BY i) - t AS T FROM pl),
pw AS (SELECT recording_id, i, T AS t0,
              lag(T, 1) OVER w AS tm1, lag(T, 2) OVER w AS tm2, lead(T, 1) OVER w AS tp1, lead(T, 2) OVER w AS tp2
       FROM pe WHERE T IS NOT NULL WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
ag AS (SELECT recording_id,
              avg(CASE WHEN """ + ok("t0") + """ THEN t0 END) AS mt,
              avg(CASE WHEN """ + loc + """ THEN abs(t0 - tm1) END) AS a_,
              avg(CASE WHEN """ + rap + """ THEN abs(t0 - (tm1 + t0 + tp1) / 3.0) END) AS r_,
              avg(CASE WHEN """ + ppq + """ THEN abs(t0 - (tm2 + tm1 + t0 + tp1 + tp2) / 5.0) END) AS p_
       FROM pw GROUP BY 1)
SELECT r.recording_id,
       round(coalesce(a_ / mt, 0.0), 9) AS jitter_local, round(coalesce(a_, 0.0), 9) AS jitter_abs,
       round(coalesce(r_ / mt, 0.0), 9) AS jitter_rap, round(coalesce(p_ / mt, 0.0), 9) AS jitter_ppq5,
       round(coalesce(3.0 * r_ / mt, 0.0), 9) AS jitter_ddp
FROM recs r LEFT JOIN ag USING (recording_id)"""


SQL_JITTER = _jitter_sql()


def _shimmer_sql() -> str:
    lo, hi, mr, ar = C.JITTER_T_MIN, C.JITTER_T_MAX, C.JITTER_MAX_RATIO, C.SHIMMER_MAX_AMP_RATIO
    offs = list(range(-5, 7))
    tag = lambda o: f"p{o}" if o >= 0 else f"m{-o}"
    cols = []
    for o in offs:
        for c in ("t", "amp"):
            if o == 0:
                cols.append(f"{c} AS {c}_p0")
            elif o > 0:
                cols.append(f"lead({c}, {o}) OVER w AS {c}_{tag(o)}")
            else:
                cols.append(f"lag({c}, {-o}) OVER w AS {c}_{tag(o)}")
    per = lambda o: f"(t_{tag(o + 1)} - t_{tag(o)})"
    def per_ok(o):
        return f"(t_{tag(o)} IS NOT NULL AND t_{tag(o + 1)} IS NOT NULL AND {per(o)} BETWEEN {lo} AND {hi})"
    def rat(a, b, lim):
        return f"(greatest({a}, {b}) / least({a}, {b}) <= {lim})"
    def wok(l, h):
        parts = []
        for o in range(l, h):
            parts += [per_ok(o), rat(f"amp_{tag(o)}", f"amp_{tag(o + 1)}", ar)]
        for o in range(l, h - 1):
            parts.append(rat(per(o), per(o + 1), mr))
        return " AND ".join(parts)
    def apq(h):
        m = "(" + " + ".join(f"amp_{tag(o)}" for o in range(-h, h + 1)) + f") / {float(2 * h + 1)}"
        return f"avg(CASE WHEN {wok(-h, h)} THEN abs(amp_p0 - {m}) END)"
    return "WITH " + FRAMES + "," + PULSES + """,
sw AS (SELECT recording_id, i, """ + ", ".join(cols) + """ FROM pl WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
ag AS (SELECT recording_id, avg(amp_p0) AS ma,
              avg(CASE WHEN """ + wok(-1, 0) + """ THEN abs(amp_p0 - amp_m1) END) AS l_,
              avg(CASE WHEN """ + wok(-1, 0) + """ THEN abs(20.0 * log10(amp_p0 / amp_m1)) END) AS d_,
              """ + apq(1) + """ AS a3, """ + apq(2) + """ AS a5, """ + apq(5) + """ AS a11
       FROM sw GROUP BY 1)
SELECT r.recording_id,
       round(coalesce(l_ / ma, 0.0), 6) AS shimmer_local, round(coalesce(d_, 0.0), 6) AS shimmer_db,
       round(coalesce(a3 / ma, 0.0), 6) AS shimmer_apq3, round(coalesce(a5 / ma, 0.0), 6) AS shimmer_apq5,
       round(coalesce(a11 / ma, 0.0), 6) AS shimmer_apq11, round(coalesce(3.0 * a3 / ma, 0.0), 6) AS shimmer_dda
FROM recs r LEFT JOIN ag USING (recording_id)"""


SQL_SHIMMER = _shimmer_sql()

SQL_HARMONICITY = "WITH " + FRAMES + """,
h AS (SELECT recording_id, avg(10.0 * log10(r / (1.0 - r))) AS h FROM frames
      WHERE f0 > 0 AND NOT isnan(f0) AND r > 0 AND r < 1 GROUP BY 1),
j AS (SELECT r.recording_id, coalesce(h, 0.0) AS hnr FROM recs r LEFT JOIN h USING (recording_id))
SELECT recording_id, round(hnr, 6) AS HNR, round(CASE WHEN hnr > 0 THEN 1.0 / (hnr + 1e-6) ELSE 0.1 END, 6) AS NHR FROM j"""

VEC_SQL = """
vec AS (SELECT * FROM (
          SELECT vf.recording_id, i, x AS x0, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, n
          FROM vf JOIN nv USING (recording_id) WINDOW w AS (PARTITION BY vf.recording_id ORDER BY i))
        WHERE i < n - 3)"""

SQL_DELAY_VECTORS = "WITH " + FRAMES + "," + VEC_SQL + "\nSELECT recording_id, i, x0, x1, x2 FROM vec"

D2_SQL = VEC_SQL + """,
pr AS (SELECT a.recording_id, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)
                                   + (a.x2 - b.x2) * (a.x2 - b.x2)) AS d
       FROM vec a JOIN vec b ON a.recording_id = b.recording_id WHERE a.n > 15),
ep AS (SELECT recording_id, quantile_cont(d, 0.25) FILTER (WHERE d > 0) AS e25,
              quantile_cont(d, 0.5) FILTER (WHERE d > 0) AS e50,
              quantile_cont(d, 0.75) FILTER (WHERE d > 0) AS e75 FROM pr GROUP BY 1),
ci AS (SELECT recording_id, any_value(e25) e25, any_value(e50) e50, any_value(e75) e75,
              count_if(d < e25) / count(*) AS c25, count_if(d < e50) / count(*) AS c50,
              count_if(d < e75) / count(*) AS c75 FROM pr JOIN ep USING (recording_id) GROUP BY 1),
pts AS (SELECT recording_id, c25, c75, unnest([e25, e50, e75]) AS e, unnest([c25, c50, c75]) AS c FROM ci),
fd AS (SELECT recording_id, any_value(c25) c25, any_value(c75) c75,
              regr_slope(ln(c + 1e-12), ln(e + 1e-12)) AS slope FROM pts GROUP BY 1)"""

SQL_CORRELATION_DIMENSION = "WITH " + FRAMES + "," + D2_SQL + """
SELECT r.recording_id, round(CASE WHEN c75 > c25 AND c25 > 0 THEN greatest(1.5, least(3.5, slope)) ELSE 2.3 END, 6) AS D2
FROM recs r LEFT JOIN fd USING (recording_id)"""

SQL_TRIM_SILENCE = "WITH " + FRAMES + """,
s AS (SELECT recording_id, frame_idx AS sample_idx, (f0 - 250.0) / 250.0 AS value,
             (row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1) // 8 AS f FROM frames),
fr AS (SELECT recording_id, f, sqrt(avg(value * value)) AS rms FROM s GROUP BY 1, 2),
mx AS (SELECT recording_id, max(rms) AS mx FROM fr GROUP BY 1),
loud AS (SELECT recording_id, min(f) AS f_lo, max(f) AS f_hi FROM fr JOIN mx USING (recording_id)
         WHERE mx > 0 AND 20.0 * log10(rms / mx) > -20.0 GROUP BY 1)
SELECT recording_id, count(*) AS kept, min(sample_idx) AS first_idx, max(sample_idx) AS last_idx
FROM s JOIN loud USING (recording_id) WHERE f BETWEEN f_lo AND f_hi GROUP BY 1"""


QUERIES = {
    "f0_summary": (q_f0_summary, SQL_F0_SUMMARY),
    "spreads": (q_spreads, SQL_SPREADS),
    "rpde": (q_rpde, SQL_RPDE),
    "ppe": (q_ppe, SQL_PPE),
    "dfa": (q_dfa, SQL_DFA),
    "jitter": (q_jitter, SQL_JITTER),
    "shimmer": (q_shimmer, SQL_SHIMMER),
    "harmonicity": (q_harmonicity, SQL_HARMONICITY),
    "correlation_dimension": (q_correlation_dimension, SQL_CORRELATION_DIMENSION),
    "delay_vectors": (q_delay_vectors, SQL_DELAY_VECTORS),
    "trim_silence": (q_trim_silence, SQL_TRIM_SILENCE),
}


# --- M19: full voice-feature row ----------------------------------------------

def q_voice_features(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.voice import voice_features
    from ..sources.tables import pulses_from_frames
    # the frames are ranked and written once; pulses derive from them
    v = voice_features(frames_r(spark, sf), pulses_from_frames, materialise=True)
    # same per-measure rounding as the single-measure queries
    digits = {"MDVP:Fo(Hz)": 4, "DFA": 5, "MDVP:Jitter(Abs)": 9, "MDVP:RAP": 9, "MDVP:PPQ": 9, "Jitter:DDP": 9}
    cols = []
    for f in C.LABELLED_FEATURES:
        c = F.col(f"`{f}`")
        if f == "MDVP:Jitter(%)":
            cols.append((F.round(c / 100.0, 9) * 100.0).alias(f))
        else:
            cols.append(F.round(c, digits.get(f, 6)).alias(f))
    return v.select(REC, *cols)


def _voice_sql() -> str:
    parts = {
        "a": (SQL_F0_SUMMARY, {"f0_mean": "MDVP:Fo(Hz)", "f0_max": "MDVP:Fhi(Hz)", "f0_min": "MDVP:Flo(Hz)"}),
        "b": (SQL_JITTER, {"jitter_local * 100.0": "MDVP:Jitter(%)", "jitter_abs": "MDVP:Jitter(Abs)",
                           "jitter_rap": "MDVP:RAP", "jitter_ppq5": "MDVP:PPQ", "jitter_ddp": "Jitter:DDP"}),
        "c": (SQL_SHIMMER, {"shimmer_local": "MDVP:Shimmer", "shimmer_db": "MDVP:Shimmer(dB)",
                            "shimmer_apq3": "Shimmer:APQ3", "shimmer_apq5": "Shimmer:APQ5",
                            "shimmer_apq11": "MDVP:APQ", "shimmer_dda": "Shimmer:DDA"}),
        "d": (SQL_HARMONICITY, {"NHR": "NHR", "HNR": "HNR"}),
        "e": (SQL_RPDE, {"RPDE": "RPDE"}),
        "f": (SQL_DFA, {"DFA": "DFA"}),
        "g": (SQL_SPREADS, {"spread1": "spread1", "spread2": "spread2"}),
        "h": (SQL_CORRELATION_DIMENSION, {"D2": "D2"}),
        "i": (SQL_PPE, {"PPE": "PPE"}),
    }
    sel = {}
    for alias, (_, m) in parts.items():
        for expr, name in m.items():
            sel[name] = f'{alias}.{expr} AS "{name}"'
    joins = " ".join(f"JOIN ({sql}) {alias} USING (recording_id)" for alias, (sql, _) in list(parts.items())[1:])
    first_alias, (first_sql, _) = next(iter(parts.items()))
    return (f"SELECT {first_alias}.recording_id, " + ", ".join(sel[f] for f in C.LABELLED_FEATURES) +
            f" FROM ({first_sql}) {first_alias} {joins}")


SQL_VOICE_FEATURES = _voice_sql()
QUERIES["voice_features"] = (q_voice_features, SQL_VOICE_FEATURES)


# --- W1 / W2 / W7 / W8 / X5: neighbour and group-relative columns -----------------

def q_series_windows(spark: SparkSession, sf: str) -> DataFrame:
    v = SG.voiced_series(series_frames(spark, sf))
    d = SG.lag_diff(v, "x")
    m3 = SG.centred_mean(v, "x", 3).select(REC, "i", "x_mean3")
    m11 = SG.centred_mean(v, "x", 11).select(REC, "i", "x_mean11")
    per = v.withColumn("period", F.lit(1.0) / (F.col("x") + F.lit(1e-6)))
    mm = SG.over_max(SG.minmax(per, "period"), "x").select(REC, "i", "period_norm", "x_share")
    out = d.join(m3, [REC, "i"], "left").join(m11, [REC, "i"], "left").join(mm, [REC, "i"])
    return out.select(REC, "i", *[F.round(c, 6).alias(c) for c in ("x", "x_diff", "x_mean3", "x_mean11",
                                                                   "period_norm", "x_share")])


SQL_SERIES_WINDOWS = "WITH " + FRAMES + """,
w AS (SELECT recording_id, i, x, x - lag(x) OVER o AS x_diff,
             CASE WHEN lag(x) OVER o IS NOT NULL AND lead(x) OVER o IS NOT NULL
                  THEN (lag(x) OVER o + x + lead(x) OVER o) / 3.0 END AS x_mean3,
             1.0 / (x + 1e-6) AS period, count(*) OVER (PARTITION BY recording_id) AS n
      FROM vf WINDOW o AS (PARTITION BY recording_id ORDER BY i)),
w11 AS (SELECT recording_id, i,
               CASE WHEN i >= 5 AND i < n - 5 THEN (""" + " + ".join(
    [f"lag(x, {k}) OVER o" for k in range(5, 0, -1)] + ["x"] + [f"lead(x, {k}) OVER o" for k in range(1, 6)]) + """) / 11.0 END AS x_mean11
        FROM w WINDOW o AS (PARTITION BY recording_id ORDER BY i)),
g AS (SELECT recording_id, min(period) AS pmn, max(period) AS pmx, max(x) AS xmx FROM w GROUP BY 1)
SELECT w.recording_id, w.i, round(x, 6) AS x, round(x_diff, 6) AS x_diff, round(x_mean3, 6) AS x_mean3,
       round(x_mean11, 6) AS x_mean11, round((period - pmn) / ((pmx - pmn) + 1e-6), 6) AS period_norm,
       round(x / xmx, 6) AS x_share
FROM w JOIN w11 USING (recording_id, i) JOIN g USING (recording_id)"""

QUERIES["series_windows"] = (q_series_windows, SQL_SERIES_WINDOWS)
