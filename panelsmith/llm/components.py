"""Groups of linked nodes, without bringing links to the driver.

Links are rewritten round by round until each points from a node to the
smallest node of its group: first every node's larger neighbours are linked to
its smallest neighbour, then its smaller ones are.  The number of rounds grows
with the logarithm of the longest chain; stars take one.  Each round's links
are written to the shared folder; the driver sees one number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.storage import settle


def _to_smallest(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links (a > b): the neighbours of each node (only the smaller, or all) to the smallest of them and itself."""
    around = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    if both_ways:
        around = around.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
    least = around.groupBy("node").agg(F.min("near").alias("least"))
    least = least.withColumn("least", F.least("least", "node"))
    joined = around.join(least, "node")
    if both_ways:  # larger neighbours only
        return joined.filter("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    moved = joined.filter("near > least").select(F.col("near").alias("a"), F.col("least").alias("b"))
    own = least.filter("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(own)


def _unsettled(links: DataFrame) -> bool:
    """Whether some node has two links, or is linked to and has one: groups are not yet stars around their smallest."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return nodes.agg(F.coalesce(F.max(F.expr("out > 1 or (out = 1 and in = 1)")), F.lit(False))).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """``(node, component)`` for every linked node; the component is its smallest node.

    Links are pairs of ids in any order, repeated or not; pairs with a null or
    of one node with itself are no links.  Nodes without links have no row.
    With ``rounds`` the work ends after so many of them: nodes of one component
    are then surely connected, but a group may still be in several.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b")  # a null gives a = b
    now = settle(now.distinct(), "links")
    done = 0
    while _unsettled(now) if rounds is None else done < rounds:
        now = settle(_to_smallest(_to_smallest(now, True), False).distinct(), "links")
        done += 1
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return ends.groupBy("node").agg(F.min("component").alias("component"))
