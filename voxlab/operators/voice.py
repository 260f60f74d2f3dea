"""The full voice-feature row per recording.

All measures are computed from the same long tables and joined on
``recording_id`` (one row per recording on every side).  The frames and the ranked
voiced series, whose rows carry their recording's constants, are written once to
the shared checkpoint folder because about ten measures read them; the pulses are
ranked once for jitter and shimmer together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalar import to_percent
from ..session import cut_lineage
from . import signal as SG
from .correlation import correlation_dimension

REC = SG.REC

# Measure column -> feature name of the labelled set.
MEASURE_TO_FEATURE = {
    "f0_mean": "MDVP:Fo(Hz)",
    "f0_max": "MDVP:Fhi(Hz)",
    "f0_min": "MDVP:Flo(Hz)",
    "jitter_percent": "MDVP:Jitter(%)",
    "jitter_abs": "MDVP:Jitter(Abs)",
    "jitter_rap": "MDVP:RAP",
    "jitter_ppq5": "MDVP:PPQ",
    "jitter_ddp": "Jitter:DDP",
    "shimmer_local": "MDVP:Shimmer",
    "shimmer_db": "MDVP:Shimmer(dB)",
    "shimmer_apq3": "Shimmer:APQ3",
    "shimmer_apq5": "Shimmer:APQ5",
    "shimmer_apq11": "MDVP:APQ",
    "shimmer_dda": "Shimmer:DDA",
    "NHR": "NHR",
    "HNR": "HNR",
    "RPDE": "RPDE",
    "DFA": "DFA",
    "spread1": "spread1",
    "spread2": "spread2",
    "D2": "D2",
    "PPE": "PPE",
}


def voice_measures(frames: DataFrame, pulses: DataFrame | Callable[[DataFrame], DataFrame], samples: DataFrame | None = None,
                   materialise: bool = True) -> DataFrame:
    """All 22 measures per recording, measure-named columns.  ``pulses`` may be what makes them from the written frames."""
    if materialise:
        frames = cut_lineage(frames)
    if callable(pulses):
        pulses = pulses(frames)
    recs = SG.recordings(frames)
    # the ranked voiced series feeds RPDE, PPE, DFA and D2
    vs = cut_lineage(SG.ranked_voiced(frames)) if materialise else SG.ranked_voiced(frames)
    parts = [
        SG.f0_summary(frames).drop("n_voiced"),
        SG.jitter_shimmer(pulses).withColumn("jitter_percent", to_percent("jitter_local")).drop("jitter_local"),
        SG.harmonicity(frames) if "r" in frames.columns else
        recs.select(REC, F.lit(0.0).alias("HNR"), F.lit(C.DEFAULT_NHR).alias("NHR")),
        SG.rpde(frames, series=vs), SG.ppe(frames, series=vs), SG.spreads(frames),
        SG.dfa(SG.dfa_signal(frames, samples, series=vs), all_recordings=recs),
        correlation_dimension(frames, series=vs),
    ]
    out = recs
    for p in parts:
        out = out.join(p, REC, "left")
    return out


def voice_features(frames: DataFrame, pulses: DataFrame | Callable[[DataFrame], DataFrame], samples: DataFrame | None = None,
                   feats: Sequence[str] = C.LABELLED_FEATURES, materialise: bool = True) -> DataFrame:
    """One row per recording with exactly ``feats`` (in order): the measured
    value where a measure maps to the name, 0.0 otherwise."""
    m = voice_measures(frames, pulses, samples, materialise)
    by_name = {v: k for k, v in MEASURE_TO_FEATURE.items()}
    cols = [F.coalesce(F.col(by_name[f]), F.lit(0.0)).alias(f) if f in by_name else F.lit(0.0).alias(f) for f in feats]
    return m.select(REC, *cols)
