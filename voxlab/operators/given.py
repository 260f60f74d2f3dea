"""Models from given parameters.

A published model comes as numbers: weights and an intercept, or trees of
which the splits are known.  Weights make a Spark model as they are.  For trees
of known splits the statistics of every node (rows, mean, variance) are
estimated from a table in one aggregate, so the leaves' values, the gains and the
covers that attributions need are those of that table.

All models are Spark's own, so they are scored, saved, explained and loaded like
fitted ones.

Defined results: a null or NaN feature goes right at every split; a node without
rows takes its parent's mean; rows without a target don't count; a table
without rows gives values and gains of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A split (feature, threshold, left, right): rows at or under the threshold go left; None is a leaf.
Split = tuple | None


def given_logistic(spark: SparkSession, weights: Sequence[float], intercept: float, uid: str = "given_logistic") -> LogisticRegressionModel:
    """A logistic model of these weights, in the order of its features."""
    sc = spark.sparkContext
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, _py2java(sc, Vectors.dense(list(map(float, weights)))), float(intercept))
    return LogisticRegressionModel(made)


def given_linear(spark: SparkSession, weights: Sequence[float], intercept: float, uid: str = "given_linear") -> LinearRegressionModel:
    """A linear model of these weights, in the order of its features."""
    sc = spark.sparkContext
    made = sc._jvm.org.apache.spark.ml.regression.LinearRegressionModel(uid, _py2java(sc, Vectors.dense(list(map(float, weights)))), float(intercept))
    return LinearRegressionModel(made)


def leaf_conditions(tree: Split, column=lambda f: F.col(f"`{f}`")) -> list[Column]:
    """The condition of every leaf, left to right."""
    if tree is None:
        return [F.lit(True)]
    feature, threshold, left, right = tree
    under = F.coalesce(column(feature) <= F.lit(float(threshold)), F.lit(False))
    return [under & c for c in leaf_conditions(left, column)] + [~under & c for c in leaf_conditions(right, column)]


def leaf_statistics(df: DataFrame, target: str, trees: Sequence[Split]) -> list[list[tuple[float, float, float]]]:
    """(rows, sum, sum of squares) of the target in every leaf of every tree, by one aggregate."""
    y = F.col(f"`{target}`").cast("double")
    known = df.where(y.isNotNull())
    per = [leaf_conditions(t) for t in trees]
    aggs = [F.coalesce(a, F.lit(0.0)).cast("double") for own in per for c in own
            for a in (F.count_if(c), F.sum(F.when(c, y)), F.sum(F.when(c, y * y)))]
    row = list(known.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).first())
    flat = iter(zip(row[0::3], row[1::3], row[2::3]))
    return [[next(flat) for _ in own] for own in per]


def estimated_ensemble(df: DataFrame, feats: Sequence[str], target: str, trees: Sequence[Split],
                       weights: Sequence[float] | None = None, uid: str = "given_trees") -> GBTRegressionModel:
    """An ensemble of the given splits with the node statistics of ``df``; ``weights`` default to 1 / trees."""
    feats, trees = list(feats), list(trees)
    sc = df.sparkSession.sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    ml = jvm.org.apache.spark.ml

    def doubles(xs):
        arr = gateway.new_array(jvm.double, len(xs))
        for i, x in enumerate(xs):
            arr[i] = float(x)
        return arr

    def node(tree: Split, leaves):
        """(what makes the JVM node, given its parent's mean; statistics of the rows in it)."""
        if tree is None:
            stats = next(leaves)
            return lambda mean: ml.tree.LeafNode(_mean(stats, mean), _variance(stats), _calculator(stats)), stats
        feature, threshold, left, right = tree
        make_left, l = node(left, leaves)
        make_right, r = node(right, leaves)
        stats = tuple(a + b for a, b in zip(l, r))

        def make(mean):
            own = _mean(stats, mean)
            gain = _variance(stats) - sum(s[0] / stats[0] * _variance(s) for s in (l, r)) if stats[0] else 0.0
            return ml.tree.InternalNode(own, _variance(stats), gain, make_left(own), make_right(own),
                                        ml.tree.ContinuousSplit(feats.index(feature), float(threshold)), _calculator(stats))
        return make, stats

    def _calculator(stats):
        return jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(doubles(stats), int(stats[0]))

    made = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    for i, (tree, stats) in enumerate(zip(trees, leaf_statistics(df, target, trees))):
        make, _ = node(tree, iter(stats))
        made[i] = ml.regression.DecisionTreeRegressionModel(f"{uid}_{i}", make(0.0), len(feats))
    weights = [1.0 / len(trees)] * len(trees) if weights is None else list(weights)
    return GBTRegressionModel(ml.regression.GBTRegressionModel(uid, made, doubles(weights), len(feats)))


def _mean(stats, default: float) -> float:
    return stats[1] / stats[0] if stats[0] else default


def _variance(stats) -> float:
    return max(0.0, stats[2] / stats[0] - (stats[1] / stats[0]) ** 2) if stats[0] else 0.0
