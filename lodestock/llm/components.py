"""Connected components of a table of links, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestock.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node that has a link.

    links: columns u, v (long). In a round every node takes its smallest neighbour, two rounds of
    pointer jumping flatten what that made, and the links are written anew between the roots, without
    repeats. Each round ends with a written table; the number of rounds grows with the logarithm of the
    longest chain. Nothing is collected but whether links are left.
    """
    both = links.filter("u != v")
    both = saved(both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = saved(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not both.isEmpty():
        parents = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("parent"))
        for _ in range(2):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parents = parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        parents = saved(parents, "parents")
        at = lambda name: parents.select(F.col("node").alias(name), F.col("parent").alias("p" + name))
        labels = saved(labels.join(parents.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        both = saved(both.join(at("u"), "u").join(at("v"), "v").filter("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "links")
    return labels
