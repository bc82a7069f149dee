"""Connected components by contraction, for graphs of any size and shape.

In a round every node points to the neighbour (or itself) of the smallest hash, edges move to what
their ends point to, and loops and repeated edges go. Hash order makes long descending chains
unlikely, so the edges shrink by a constant factor a round. The pointers of all rounds, followed
one after another, name each node's component. Every round is written, so a lost executor costs one
round; a hub's edges combine before the shuffle and its join is split by adaptive execution.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.storage import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that has an edge to another node."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    left = materialise(edges.where("a != b").select(low.alias("a"), high.alias("b")).distinct())
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to")))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("to"))
        pointers = materialise(both.groupBy(F.col("a").alias("node")).agg(best.alias("best"))
                               .select("node", F.least("best", own)["to"].alias("to")))
        rounds.append(pointers)
        ends = left.join(pointers.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(pointers.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        left = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = rounds[-1].select("node", F.col("to").alias("root"))
    for pointers in reversed(rounds[:-1]):
        later = named.select(F.col("node").alias("to"), "root")
        named = materialise(pointers.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return named
