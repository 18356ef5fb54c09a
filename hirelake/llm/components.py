"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) for every node of edges (a, b); nodes without edges are absent.

    Alternating large and small stars: each round points every node's neighbours at the least one among them. Rounds
    grow with the logarithm of the longest chain; each is two aggregations and two joins on the node, written to the
    shared folder. Null ends and loops are ignored, and repeated edges count once.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        # Large star: neighbours greater than a node go to the least of its neighbourhood.
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        # Small star: a node and its lesser neighbours go to the least of these.
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        edges = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(small.select("v", F.col("m").alias("u"))).where("v != u").distinct()
        edges = written(edges, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
