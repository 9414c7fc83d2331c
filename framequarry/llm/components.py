"""Connected components over an edge table, without ever gathering edges or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import stored


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge: root is the smallest node of its component.

    Alternates a large-star and a small-star step until nothing changes: each round that changes
    anything ties some node to a smaller one, and their number grows with the logarithm of a component's
    width. A round is two aggregations (partial sums before the shuffle, so a node with very many
    neighbours is no hot key there) and a join, and is written to the shared folder. Input: columns a, b
    of one orderable type without nulls; loops, repeats and either direction are allowed. An empty table
    gives an empty one.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    pairs = stored(pairs, "cc")
    known = _digest(pairs)
    while True:
        # large star: every neighbour above a node is tied to the smallest of the node and its neighbours
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = stored(small.where("u > v").distinct(), "cc")
        before, known = known, _digest(pairs)
        if known == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(pairs: DataFrame) -> Row:
    """One row that tells two sets of edges apart."""
    return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
