"""Connected components of an undirected graph, by alternating stars.

Every round is two pre-aggregated minima and two joins over the edges; edges
shrink towards one star per component, in about a logarithm of the longest
path.  Rounds are cut through written tables; only a count of the nodes that
are not settled reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut


def settled(edges: DataFrame) -> bool:
    """Every node that links to a smaller one links to one only, and none links to it: the edges are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1").agg(F.count(F.lit(1))).first()[0]


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node with an edge, the label being the component's least node.  Edges: ``a, b``."""
    state = cut(edges.filter("a <> b").select("a", "b"), "components")
    while True:
        state = cut(small_star(large_star(state)), "components")
        if settled(state):
            break
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).union(state.select("b", "b").distinct())
