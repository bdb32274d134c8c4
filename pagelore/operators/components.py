"""Connected components of a graph given by its edges, in a number of rounds that grows with the logarithm of the nodes.

A round points every node at the least of its neighbourhood by a hash that changes with the round, follows that pointer once
more, and contracts the edges.  A fresh random order merges a constant share of the nodes in expectation, chains
in order among them.  Edges shrink and are written to the checkpoint folder each round, so the plan stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (one of its nodes) for edges ``a``, ``b``; a loop names a node on its own."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("a", "b").distinct().checkpoint()
    known = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")).checkpoint()
    edges, turn = edges.filter(F.col("a") != F.col("b")), 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select(F.col("a").alias("node"), F.least(rank("a"), "least")["node"].alias("up"))
        again = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        jumped = up.join(again, "up").select("node", "root").checkpoint()
        end = lambda name: jumped.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        low, high = F.least("a_root", "b_root"), F.greatest("a_root", "b_root")
        edges = edges.join(end("a"), "a").join(end("b"), "b").select(low.alias("a"), high.alias("b")).filter(F.col("a") != F.col("b")).distinct().checkpoint()
        moved = jumped.withColumnRenamed("node", "component")
        known = known.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")).checkpoint()
        turn += 1
    return known


def pair_key(kind: str, c: str) -> Column:
    """A node name that keeps kinds apart."""
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
