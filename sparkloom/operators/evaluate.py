"""Retrieval evaluation: reciprocal ranks, score percentiles, overlap of result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def rank_all(hits: DataFrame) -> DataFrame:
    """id, score and rank (score falling, id rising) of any number of hits, without one task for all.

    Rows are sorted by range; a row's rank is its place in its partition plus the rows before it."""
    part = hits.select("id", "score").repartitionByRange(F.desc("score"), "id").sortWithinPartitions(F.desc("score"), "id")
    placed = part.withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33).cast("int"))
    # written once: a second run of the range sort may draw other bounds
    placed = cut(placed.withColumn("at", F.col("m") - F.shiftleft(F.col("p").cast("long"), 33)))
    counts = {r["p"]: r["count"] for r in placed.groupBy("p").count().collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    offsets = hits.sparkSession.createDataFrame(before, "p int, before long")
    return placed.join(F.broadcast(offsets), "p").select("id", "score", (F.col("before") + F.col("at") + 1).alias("rank"))


def mean_reciprocal_rank(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """n_queries and mrr over queries with a hit; hits (id, rank[, query]) and relevant (query, id)."""
    on = ["query", "id"] if "query" in hits.columns else ["id"]
    best = relevant.join(hits, on).groupBy("query").agg(F.min("rank").alias("rank"))
    return best.agg(F.count(F.lit(1)).alias("n_queries"), F.avg(1 / F.col("rank")).alias("mrr"))


def score_percentiles(hits: DataFrame) -> DataFrame:
    return hits.agg(F.percentile("score", F.lit(0.5)).alias("p50"), F.percentile("score", F.lit(0.9)).alias("p90"), F.avg("score").alias("mean"), F.max("score").alias("top"))


def overlap(few: DataFrame, more: DataFrame) -> DataFrame:
    """The share of few's ids that more holds as well."""
    both = few.select("id").distinct().join(more.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("overlap"))
