"""Connected components by repeated contraction, without collecting links or classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is its smallest node.

    Each round hands every node to its smallest neighbour and merges both ends of the links, which at least halves the
    nodes that still have links. Sums are taken before the shuffle, so a node with very many links is no hot spot.
    """
    edges = cut_lineage(_distinct(edges), "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = ends.withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        parent = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        parent = cut_lineage(parent, "parents")
        moved = found.join(parent, F.col("component") == F.col("u"), "left")
        found = cut_lineage(moved.select("node", F.coalesce("p", "component").alias("component")), "components")
        left = edges.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b")
        edges = cut_lineage(_distinct(left.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "links")
    return found
