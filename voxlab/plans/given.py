"""Scoring, severity, importance and attribution of models with given parameters, checked by value.

The models are fixed numbers, or fixed splits whose node statistics come from
the labelled table; SQL states the same results in closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import explain as X
from ..operators.given import estimated_ensemble, given_linear, given_logistic
from ..operators.project import assemble
from ..operators.scoring import score, score_record, score_severity
from ..operators.treeshap import tree_attribution
from ..sources.tables import EVENT_FEATURES, labelled_events
from .screening import LABELLED_EVENTS_SQL

WEIGHTS = {"value": 0.02, "hour": -0.03, "k": 0.004, "user_n": -0.005, "user_mean": 0.01}
BIAS = -0.9
BAND_WEIGHTS = {"value": 0.11, "hour": -0.7, "k": 0.13}
BAND_BIAS = 21.0
# no feature occurs twice on a path, so attributions have a closed form
TREES = [
    ("value", 30.5, ("hour", 11.5, None, None), ("k", 50.5, None, None)),
    ("user_mean", 50.25, ("value", 80.5, None, None), ("hour", 6.5, None, None)),
    ("k", 20.5, None, ("user_n", 70.5, None, None)),
]


def _round(c: str, digits: int = 6):
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)  # no negative zero


def _logistic(spark: SparkSession):
    return given_logistic(spark, [WEIGHTS[f] for f in EVENT_FEATURES], BIAS)


def q_batch_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Class, probabilities and confidence of every labelled row."""
    s = score(labelled_events(spark, sf), _logistic(spark), EVENT_FEATURES)
    return s.select("event_id", "prediction", _round("p_healthy"), _round("p_positive"), _round("confidence"))


def q_record_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled row of the highest value (ties: first key) as a record that lacks ``hour`` (0.0)."""
    first = labelled_events(spark, sf).orderBy(F.col("value").desc(), "event_id").limit(1).first().asDict()
    record = {f: first[f] for f in EVENT_FEATURES if f != "hour"}
    out = score_record(spark, record, _logistic(spark), EVENT_FEATURES, "Logistic Regression")
    flag, healthy, positive, confidence, used = C.RECORD_FIELDS
    return out.select(flag, _round(healthy), _round(positive), _round(confidence), used)


def q_severity_of_positives(spark: SparkSession, sf: str) -> DataFrame:
    """Severity, band and margin of the rows that the classifier calls positive."""
    s = score(labelled_events(spark, sf), _logistic(spark), EVENT_FEATURES)
    model = given_linear(spark, list(BAND_WEIGHTS.values()), BAND_BIAS)
    out = score_severity(s, model, list(BAND_WEIGHTS))
    return out.select("event_id", _round("severity"), "severity_band", "severity_color", "severity_margin")


def _ensemble(spark: SparkSession, sf: str):
    df = labelled_events(spark, sf)
    return estimated_ensemble(df, EVENT_FEATURES, "status", TREES), df


def q_ensemble_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Features by gain, the largest with intensity 1."""
    model, _ = _ensemble(spark, sf)
    top = X.top_importance(X.feature_importance(spark, model, EVENT_FEATURES), C.TOP_IMPORTANCE)
    return top.select("feature_idx", "feature", _round("importance"), _round("intensity"))


def q_ensemble_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """The ensemble's score of every row and what each feature adds to the base value."""
    model, df = _ensemble(spark, sf)
    scores = model.transform(assemble(df, EVENT_FEATURES, "features")).select("event_id", F.col("prediction").alias("score"))
    return tree_attribution(df, "event_id", EVENT_FEATURES, model).join(scores, "event_id") \
        .select("event_id", "feature", _round("value"), _round("base_value"), _round("score"))


# --- SQL ------------------------------------------------------------------------

def _linear(weights: dict, bias: float, absent: tuple[str, ...] = ()) -> str:
    return " + ".join([f"({bias})", *[f"({w}) * {f}" for f, w in weights.items() if f not in absent]])


def _logistic_sql(absent: tuple[str, ...] = ()) -> str:
    return ("WITH " + LABELLED_EVENTS_SQL + ",\nscored AS (SELECT *, 1 / (1 + exp(-(" + _linear(WEIGHTS, BIAS, absent) + "))) AS p FROM labelled)\n")


SQL_BATCH_SCORES = _logistic_sql() + """SELECT event_id, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, round(1 - p, 6) AS p_healthy,
       round(p, 6) AS p_positive, round(greatest(p, 1 - p), 6) AS confidence FROM scored"""

SQL_RECORD_FIELDS = _logistic_sql(("hour",)) + "SELECT " + ", ".join(
    f"{e} AS {f}" for e, f in zip(("p > 0.5", "round(1 - p, 6)", "round(p, 6)", "round(greatest(p, 1 - p), 6)", "'Logistic Regression'"), C.RECORD_FIELDS)) \
    + "\nFROM scored ORDER BY value DESC, event_id LIMIT 1"

SQL_SEVERITY_OF_POSITIVES = _logistic_sql() + """, sv AS (SELECT event_id, greatest(0.0, least(59.0, """ + _linear(BAND_WEIGHTS, BAND_BIAS) + """)) AS severity
                     FROM scored WHERE p > 0.5),
r AS (SELECT *, round_even(severity, 0) AS s FROM sv)
SELECT event_id, round(severity, 6) AS severity,
       CASE WHEN s BETWEEN 0 AND 10 THEN 'None / Minimal' WHEN s BETWEEN 11 AND 30 THEN 'Mild' WHEN s BETWEEN 31 AND 58 THEN 'Moderate' ELSE 'Severe' END AS severity_band,
       CASE WHEN s BETWEEN 0 AND 10 THEN '#27AE60' WHEN s BETWEEN 11 AND 30 THEN '#F39C12' WHEN s BETWEEN 31 AND 58 THEN '#E67E22' ELSE '#E74C3C' END AS severity_color,
       CAST(5.2 AS DOUBLE) AS severity_margin
FROM r"""


def _paths(tree, path=()):
    """Every node as (path, split or None): path is a tuple of (feature, threshold, goes left)."""
    out = [(path, tree)]
    if tree is not None:
        f, t, left, right = tree
        out += _paths(left, (*path, (f, t, True))) + _paths(right, (*path, (f, t, False)))
    return out


def _test(step) -> str:
    f, t, left = step
    return f"coalesce({f} <= {t}, FALSE)" if left else f"NOT coalesce({f} <= {t}, FALSE)"


def _name(tree: int, path) -> str:
    return f"{tree}_" + "".join("l" if left else "r" for *_, left in path)


def _statistics_sql() -> str:
    """CTE st: rows n_, mean m_ and variance v_ of the label in every node, one row."""
    cols = []
    for i, tree in enumerate(TREES):
        for path, _ in _paths(tree):
            where = f" FILTER (WHERE {' AND '.join(map(_test, path))})" if path else ""
            n = _name(i, path)
            cols += [f"CAST(count(*){where} AS DOUBLE) AS n_{n}", f"avg(status){where} AS m_{n}", f"var_pop(status){where} AS v_{n}"]
    return "WITH " + LABELLED_EVENTS_SQL + ",\nst AS (SELECT " + ",\n  ".join(cols) + " FROM labelled)"


def _importance_sql() -> str:
    rows = []
    for i, tree in enumerate(TREES):
        for path, split in _paths(tree):
            if split is not None:
                n, left, right = (_name(i, p) for p in (path, (*path, (split[0], split[1], True)), (*path, (split[0], split[1], False))))
                rows.append(f"SELECT '{split[0]}' AS feature, n_{n} * v_{n} - n_{left} * coalesce(v_{left}, 0) - n_{right} * coalesce(v_{right}, 0) AS g FROM st")
    index = ", ".join(f"({i}, '{f}')" for i, f in enumerate(EVENT_FEATURES))
    return _statistics_sql() + ",\ngains AS (" + "\nUNION ALL ".join(rows) + "),\nsums AS (SELECT feature, sum(g) AS g FROM gains GROUP BY feature),\n" \
        f"f AS (SELECT i, t.feature, coalesce(g, 0) AS g FROM (VALUES {index}) t(i, feature) LEFT JOIN sums ON sums.feature = t.feature)\n" \
        "SELECT i AS feature_idx, feature, round(g / sum(g) OVER (), 6) AS importance, round(g / max(g) OVER (), 6) AS intensity FROM f"


def _attribution_sql() -> str:
    """Two features a and b on a path to a leaf of value m add m (o_a - z_a)(o_b + z_b) / 2 and the like; one feature alone m (o - z)."""
    value = {f: [] for f in EVENT_FEATURES}
    base, total = [], []
    for i, tree in enumerate(TREES):
        for path, split in _paths(tree):
            if split is not None:
                continue
            leaf = _name(i, path)
            m = f"coalesce(m_{leaf}, 0) / {len(TREES)}"
            share = [f"(n_{_name(i, path[:k + 1])} / n_{_name(i, path[:k])})" for k in range(len(path))]
            met = [f"CASE WHEN {_test(s)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for s in path]
            base.append(f"{m} * n_{leaf} / n_{_name(i, ())}")
            total.append(f"{m} * " + " * ".join(f"({o})" for o in met))
            for k, (f, *_) in enumerate(path):
                rest = "".join(f" * (({met[j]}) + {share[j]}) / 2" for j in range(len(path)) if j != k)
                value[f].append(f"{m} * (({met[k]}) - {share[k]})" + rest)
    rows = "\nUNION ALL ".join(
        f"SELECT event_id, '{f}' AS feature, {' + '.join(value[f])} AS value, {' + '.join(base)} AS base_value, {' + '.join(total)} AS score FROM labelled, st"
        for f in EVENT_FEATURES)
    return _statistics_sql() + ",\natt AS (" + rows + ")\nSELECT event_id, feature, round(value, 6) + 0.0::DOUBLE AS value, round(base_value, 6) AS base_value, " \
        "round(score, 6) AS score FROM att"


QUERIES = {
    "batch_scores": (q_batch_scores, SQL_BATCH_SCORES),
    "record_fields": (q_record_fields, SQL_RECORD_FIELDS),
    "severity_of_positives": (q_severity_of_positives, SQL_SEVERITY_OF_POSITIVES),
    "ensemble_importance": (q_ensemble_importance, _importance_sql()),
    "ensemble_attribution": (q_ensemble_attribution, _attribution_sql()),
}
