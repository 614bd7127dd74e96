"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node of the edges (a, b), whose type can be ordered.

    Edges are turned into stars in rounds: each node hands its least neighbour to its larger ones, then to its smaller ones.
    The number of rounds grows with the logarithm of a component's size; nothing of a component is ever gathered.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while not stars.isEmpty():
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        stars = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # a's larger neighbours
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        smaller = stars.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = written(smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
