"""Connected components over link tables, by alternating star contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) for every node of links (a, b), as longs.

    Each round turns every node's neighbours to its smallest one: first all larger neighbours, then
    the smaller ones, until the edges are stars. A node of very many neighbours is only ever met by
    a minimum that is combined before the shuffle, and by joins on the node."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).distinct()
        fresh = materialise(small, name)
        change = fresh.select("a", "b", F.lit(1).alias("s")).union(edges.select("a", "b", F.lit(-1).alias("s"))).groupBy("a", "b").agg(F.sum("s").alias("s")).where("s <> 0").limit(1).count()
        edges = fresh
        if not change:
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
