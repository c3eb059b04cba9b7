"""Connected components of an edge table by alternating star contraction.

Each round hangs every neighbour of a node on the smallest node it sees, first
upward, then downward, until a round changes nothing; the rounds grow with the
logarithm of the number of nodes. Edges stay in tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """(node, low): every edge in both directions with each node's least."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("low"))
    return both.join(least, F.col("u") == F.col("node")).select("u", "v", "low")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node with an edge.

    ``edges`` has two columns of one type; loops and repeats do no harm. Rounds
    grow with the logarithm of the nodes; more than ``most_rounds`` is an error
    and no unfinished result.
    """
    e = edges.toDF("a", "b").filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")
    for _ in range(most_rounds):
        if e.isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # Upward: larger neighbours go to the least of the neighbourhood.
        s = _stars(e)
        up = s.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
        up = up.filter(F.col("a") != F.col("b")).distinct()
        # Downward: smaller neighbours and the node itself go to the least.
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialise(down, "edges")
        # Done when every node hangs on one root and no root hangs on another.
        roots = new.select(F.col("b").alias("a")).distinct()
        if new.groupBy("a").count().filter("count > 1").isEmpty() and new.join(roots, "a", "left_semi").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = new
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
