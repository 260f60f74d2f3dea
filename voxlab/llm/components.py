"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _around(pairs: DataFrame) -> DataFrame:
    """(n, x): every node with each of its neighbours, over links (v, u) with u < v."""
    return pairs.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(pairs.select(F.col("v").alias("n"), F.col("u").alias("x")))


def _large_star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to its least neighbour (or itself): one link for each link, some of them equal."""
    return pairs.join(least.select(F.col("n").alias("u"), "m"), "u").select("v", F.col("m").alias("u"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours and itself to the least of them."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"))
    sent = pairs.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    return sent.unionByName(least.select("v", F.col("m").alias("u"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b); the root is the least node of the component.

    Least values are aggregated before they are shuffled and joined back to
    the links, a join that Spark splits where a node has very many.  Each step is
    written, so a lost executor costs one step; the number of steps grows
    with the logarithm of the size.  The end is seen from the least neighbours: no
    node has two smaller ones, or both a smaller and a larger one.
    """
    pairs = stage(links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    while True:
        least = stage(_around(pairs).groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"), F.count_if(F.col("x") < F.col("n")).alias("smaller"),
                                                      F.count(F.lit(1)).alias("near")), "least")
        if least.where("smaller > 1 or smaller = 1 and near > 1").isEmpty():
            break
        pairs = stage(_small_star(stage(_large_star(pairs, least), "large")), "small")
    return least.select(F.col("n").alias("node"), F.col("m").alias("root"))
