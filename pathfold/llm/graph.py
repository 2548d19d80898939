"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) reaches.

    Large-star and small-star steps in turn, each one aggregation and one join on the node, until
    every edge leads from a node to the smallest of its component. Loops and repeated edges do no
    harm; a table without edges has no rows.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Link the neighbours of each node that are larger (or not) to its smallest neighbour."""
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        joined = both.join(least, "a")
        if large:
            linked = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            linked = joined.select("b", "least").union(least.select(F.col("a").alias("b"), "least"))
            linked = linked.select(F.col("b").alias("a"), F.col("least").alias("b"))
        return linked.filter("a <> b").distinct()

    # Edges lead from the larger node to the smaller one.
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    state = None
    while True:
        pairs = cut_lineage(star(star(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
