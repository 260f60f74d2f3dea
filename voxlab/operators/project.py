"""Projections, filters and predicates (narrow, no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.scalar import fmt_percent, fmt_points, log_time, confidence
from .ordering import exact_rank, value_bucket


def _q(name: str) -> Column:
    """Column by exact name (names may hold ':', '(', '%', '#')."""
    return F.col(f"`{name}`")


# ---- P1-P12 ---------------------------------------------------------------

def harmonise(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by dictionary; keys that are not columns are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def select_features(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    return df.select(*[_q(f) for f in feats])


def select_if_complete(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Feature list in order if every feature is present, else unchanged."""
    return select_features(df, feats) if all(f in df.columns for f in feats) else df


def common_columns(df: DataFrame, feats: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [f for f in feats if f in have]


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def drop_strict(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def map_values(df: DataFrame, col: str, mapping: dict, out: str) -> DataFrame:
    """Dictionary lookup of a column; keys outside the mapping give null."""
    expr = None
    for k, v in mapping.items():
        cond = _q(col) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return df.withColumn(out, expr)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def fill_absent(df: DataFrame, feats: Sequence[str], value: float = 0.0) -> DataFrame:
    """Add missing feature columns as a constant; present values (even NaN) stay."""
    missing = [f for f in feats if f not in df.columns]
    return df.withColumns({f: F.lit(float(value)) for f in missing}) if missing else df


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: _q(c).cast(t) for c, t in types.items()})


def assemble(df: DataFrame, feats: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(feats), outputCol=out, handleInvalid="keep").transform(df)


def split_probability(df: DataFrame, prob: str = "probability",
                      out0: str = "p_healthy", out1: str = "p_positive") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(prob))
    return df.withColumns({out0: arr[0], out1: arr[1]})


def row_labels(df: DataFrame, prefix: str, order: Sequence[str], by: Sequence[str] = (),
               out: str = "label", bucket: Column | None = None) -> DataFrame:
    """``'<prefix> n'`` with n = 1-based position by ``order`` inside ``by``.

    The position is the exact bucketed rank (see ``ordering``); ``bucket``
    must not decrease along ``order``; by default a log-spaced bucket of the
    first order column.
    """
    if bucket is None:
        bucket = value_bucket(F.col(order[0]).cast("double"))
    r = exact_rank(df, list(by), list(order), bucket, out="_vx_pos")
    return r.withColumn(out, F.format_string(f"{prefix} %d", F.col("_vx_pos"))).drop("_vx_pos")


def result_text(df: DataFrame, pred: str = "prediction", audio: bool = False) -> DataFrame:
    return df.withColumns({
        "result": F.when(F.col(pred) == 1, C.RESULT_POSITIVE).otherwise(C.RESULT_NEGATIVE),
        "input_type": F.lit(C.INPUT_TYPE_AUDIO if audio else C.INPUT_TYPE_CSV),
    })


def format_log(df: DataFrame, ts: str = "ts", p1: str = "p_positive") -> DataFrame:
    """Display strings of a typed prediction log (view only; the table stays typed)."""
    p0 = F.lit(1.0) - F.col(p1)
    return df.withColumns({
        "time_text": log_time(F.col(ts)),
        "p_text": fmt_percent(F.col(p1)),
        "confidence_text": fmt_percent(confidence(p0, F.col(p1))),
        "delta_positive": fmt_points(F.col(p1)),
        "delta_healthy": fmt_points(p0),
    })


def explode_named(df: DataFrame, arr: str, names: Sequence[str], keep: Sequence[str] = (),
                  idx: str = "feature_idx", name: str = "feature", value: str = "value") -> DataFrame:
    """Array column -> long rows ``(keep…, idx, name, value)``; names by position."""
    names_arr = F.array(*[F.lit(n) for n in names])
    return (df.select(*keep, F.posexplode(F.col(arr)).alias(idx, value))
            .withColumn(name, F.element_at(names_arr, F.col(idx) + 1)))


def round_metrics(df: DataFrame, cols: Sequence[str], digits: int = 4, percent: bool = False) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) * (100.0 if percent else 1.0), digits) for c in cols})


def metrics_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                 var: str = "metric", val: str = "score") -> DataFrame:
    return df.unpivot(list(ids), list(cols), var, val)


def confusion_frame(df: DataFrame, cm: str = "confusion_matrix") -> DataFrame:
    """Nested 2x2 ``[[tn, fp], [fn, tp]]`` -> rows ``(actual, predicted_healthy, predicted_positive)``."""
    names = F.array(F.lit(C.CLASS_NAMES[0]), F.lit(C.CLASS_NAMES[1]))
    return (df.select(F.posexplode(F.col(cm)).alias("i", "row"))
            .select(F.element_at(names, F.col("i") + 1).alias("actual"),
                    F.col("row")[0].alias("predicted_healthy"),
                    F.col("row")[1].alias("predicted_positive")))


def metric_or(df: DataFrame, key: str, default) -> Column:
    """Field if the column exists (null -> default), else the default."""
    return F.coalesce(F.col(key), F.lit(default)) if key in df.columns else F.lit(default)


# ---- F1-F7 ----------------------------------------------------------------

def class_filter(df: DataFrame, y: str, v, cols: Sequence[str]) -> DataFrame:
    return df.where(F.col(y) == F.lit(v)).select(*[_q(c) for c in cols])


def voiced(df: DataFrame, f0: str = "f0") -> DataFrame:
    """Voiced frames: f0 not null, not NaN and > 0."""
    return df.where(F.col(f0).isNotNull() & ~F.isnan(F.col(f0)) & (F.col(f0) > 0))


def positive(df: DataFrame, x: str) -> DataFrame:
    return df.where(F.col(x) > 0)


def validate_input(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """One row: rows, missing features, non-numeric features, null+NaN count per feature."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f for f in feats if f not in have]
    non_numeric = [f for f in feats if f in have and not isinstance(have[f], T.NumericType)]
    checks = []
    for f in feats:
        if f in have:
            c = _q(f)
            bad = c.isNull() | (F.isnan(c) if isinstance(have[f], (T.DoubleType, T.FloatType)) else F.lit(False))
            checks.append(F.count_if(bad).alias(f"missing::{f}"))
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), *checks)
    miss_map = F.map_from_arrays(F.array(*[F.lit(f) for f in feats if f in have]),
                                 F.array(*[F.col(f"`missing::{f}`") for f in feats if f in have])) if checks else F.create_map()
    return agg.select("n_rows",
                      F.array(*[F.lit(m) for m in missing]).cast("array<string>").alias("absent_features"),
                      F.array(*[F.lit(m) for m in non_numeric]).cast("array<string>").alias("non_numeric_features"),
                      miss_map.alias("missing_values"))


def positives_only(df: DataFrame, pred: str = "prediction") -> DataFrame:
    return df.where(F.col(pred) == 1)
