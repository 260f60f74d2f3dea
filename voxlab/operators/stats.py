"""Aggregations: counts, balance, ranges, percentiles, correlation, scaler fit,
distribution summaries and totals.  All use partial (map-side) aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import exact_percentiles


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def row_count() -> Column:
    """G1: aggregate that counts rows."""
    return F.count(F.lit(1))


def label_counts(df: DataFrame, y: str = "status") -> DataFrame:
    return df.agg(row_count().alias("n"),
                  F.count_if(_q(y) == 1).alias("n_positive"),
                  F.count_if(_q(y) == 0).alias("n_negative"))


def class_balance(df: DataFrame, source: str, y: str = "status", classes=(1, 0)) -> DataFrame:
    """Rows per source x class, zero cells kept (pivot with fixed values)."""
    names = {1: "n_positive", 0: "n_negative"}
    p = df.groupBy(source).pivot(y, list(classes)).count()
    return p.select(source, *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(names.get(c, f"n_{c}"))
                              for c in classes])


def nunique(col: str, approx: bool = False) -> Column:
    """Aggregate that counts distinct values."""
    return F.approx_count_distinct(col) if approx else F.countDistinct(col)


def value_range(col: str) -> list[Column]:
    """Aggregates ``min_value`` and ``max_value``."""
    return [F.min(col).alias("min_value"), F.max(col).alias("max_value")]


def percentiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Percentiles per group as ``(*by, p, value)``.

    Exact and linearly interpolated by default (bucketed ranks, no
    whole-group buffer).  ``approx=True`` opts into Spark's
    ``percentile_approx`` sketch (bounded memory per group, rank error about
    1 / ``accuracy``, returns observed values).
    """
    if not approx:
        return exact_percentiles(df, list(by), col, probs)
    ps = [float(p) for p in probs]
    q = df.groupBy(*by).agg(F.percentile_approx(F.col(col).cast("double"), ps, accuracy).alias("_vx_q"))
    return q.select(*by, F.posexplode("_vx_q").alias("_vx_i", "value")) \
        .withColumn("p", F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("_vx_i") + 1)) \
        .select(*by, "p", "value")


def fit_scaler(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """One row: ``mu_<f>``, ``sd_<f>`` (population std; zero variance -> 1)."""
    aggs = []
    for f in feats:
        aggs.append(F.avg(_q(f)).alias(f"mu_{f}"))
        sd = F.stddev_pop(_q(f))
        aggs.append(F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd).alias(f"sd_{f}"))
    return df.agg(*aggs)


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 2, method: str = "agg") -> DataFrame:
    """Pearson correlation of every pair, pairwise-complete, in long form.

    ``method="ml"`` is for wide dense input: ``ml.stat.Correlation`` on an
    assembled vector (a distributed Gramian; the d x d result is bounded by the
    feature count).  It uses complete rows only (rows with a null or NaN are
    skipped), not pairwise-complete ones.

    One aggregate computes all pairs (``corr`` skips rows where either side
    is null; NaN is turned into null first since it would poison ``corr``).
    Output ``(row_feature, col_feature, r)``; the diagonal is 1.0.
    """
    cols = list(cols)
    clean = df.select(*[F.when(F.isnan(_q(c).cast("double")), None).otherwise(_q(c).cast("double")).alias(f"c{i}")
                        for i, c in enumerate(cols)])
    if method == "ml":
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation
        v = VectorAssembler(inputCols=[f"c{i}" for i in range(len(cols))], outputCol="_vx_v",
                            handleInvalid="skip").transform(clean)
        m = Correlation.corr(v, "_vx_v").first()[0].toArray()
        rows = [(a, b, round(float(m[i, j]), digits)) for i, a in enumerate(cols) for j, b in enumerate(cols)]
        return df.sparkSession.createDataFrame(rows, "row_feature string, col_feature string, r double")
    aggs = [F.corr(f"c{i}", f"c{j}").alias(f"r_{i}_{j}") for i in range(len(cols)) for j in range(i + 1, len(cols))]
    wide = clean.agg(*aggs) if aggs else clean.agg(F.count(F.lit(1)).alias("_n"))
    entries = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                v = F.lit(1.0)
            else:
                v = F.col(f"r_{min(i, j)}_{max(i, j)}")
            entries.append(F.struct(F.lit(a).alias("row_feature"), F.lit(b).alias("col_feature"),
                                    F.round(v, digits).alias("r")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def violin_summary(df: DataFrame, feats: Sequence[str], by: str = "status") -> DataFrame:
    """Per feature and class: n, mean, min, quartiles, max (box + mean line).

    Long form via ``unpivot`` so every (feature, class) pair is one group;
    quartiles use the exact bucketed percentiles.
    """
    long = df.select(_q(by).alias("class"), *[_q(f).cast("double").alias(f) for f in feats]) \
        .unpivot(["class"], list(feats), "feature", "value").where(F.col("value").isNotNull())
    basic = long.groupBy("feature", "class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_percentiles(long, ["feature", "class"], "value", [0.25, 0.5, 0.75])
    qw = q.groupBy("feature", "class").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    return basic.join(qw, ["feature", "class"])


def log_tally(log: DataFrame, result: str = "result", positive: str = "Parkinson's Risk") -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"),
                   F.count_if(F.col(result) == positive).alias("at_risk"),
                   F.count_if(F.col(result) != positive).alias("healthy"))


def dataset_summary(df: DataFrame, y: str = "status", n_features: int = 16) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("samples"),
                  F.count_if(_q(y) == 1).alias("positives"),
                  F.count_if(_q(y) == 0).alias("healthy"),
                  F.lit(n_features).alias("features"))
