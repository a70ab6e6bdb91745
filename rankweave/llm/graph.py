"""Connected components of a graph that no machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Large-star and small-star rounds until nothing changes: each round moves
    edges towards the smallest neighbour, by a partly aggregated minimum and a
    join, never by gathering a node's neighbours. Each round's edges are
    written to the shared folder. Null ends and loops are ignored; no edges
    give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, seen = written(edges.distinct(), "edges"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen or not now.n:
            break
        seen = now
        least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "b")
        large = edges.join(least, "b", "left").select("a", F.coalesce("least", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        pulled = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = written(pulled.union(least.select("a", "least")).distinct(), "edges")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(edges.select("b", "b").distinct())
