"""Reciprocal rank fusion of ranked channels, short-text penalty, reranking with backfill, fallback by name."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_penalty

RRF_K = 60


def ranked(hits: DataFrame, channel: str, order: list) -> DataFrame:
    """id, rank from 1 and channel. hits must be a limited result: ranking it takes one task."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "rank", F.lit(channel).alias("channel"))


def rrf(channels: list[DataFrame], k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score (the sum of weight / (k + rank)) and source: DenseOnly, SparseOnly or Fused.

    channels: rows (id, rank, channel) with channels named dense and sparse."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, F.lit(float(w))).otherwise(weight)
    out = every.groupBy("id").agg(
        F.sum(weight / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.bool_or(F.col("channel") == "dense").alias("dense"), F.bool_or(F.col("channel") == "sparse").alias("sparse")
    )
    source = F.when(F.col("dense") & F.col("sparse"), "Fused").when(F.col("dense"), "DenseOnly").otherwise("SparseOnly")
    return out.select("id", "score", source.alias("source"))


def dense_and(dense: DataFrame, sparse) -> tuple[DataFrame, DataFrame | None]:
    """The dense channel (id, score) and the rows of sparse(), a function that gives the sparse channel, limited.

    sparse() is run here. Where it fails, the second is None and a warning says why."""
    try:
        found = sparse()
        return dense, found.sparkSession.createDataFrame(found.collect(), found.schema)
    except Exception as e:
        warnings.warn(f"the sparse channel failed, dense hits only: {type(e).__name__}", stacklevel=2)
        return dense, None


def dense_only(dense: DataFrame) -> DataFrame:
    """Hits of the dense channel with their own scores."""
    return dense.select("id", "score", F.lit("DenseOnly").alias("source"))


def merge_lines(fused: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """fused with line_start and line_end: the dense channel's where it has any (not 0), else the sparse one's."""
    d = dense.select("id", F.col("line_start").alias("ds"), F.col("line_end").alias("de"))
    s = sparse.select("id", F.col("line_start").alias("ss"), F.col("line_end").alias("se"))
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b), F.lit(0))
    return fused.join(d, "id", "left").join(s, "id", "left").withColumn("line_start", pick("ds", "ss")).withColumn("line_end", pick("de", "se")).drop("ds", "de", "ss", "se")


def penalise_short(hits: DataFrame, content: str = "content", resort: bool = True) -> DataFrame:
    """Scores of short texts lowered; sorted anew unless resort is False."""
    out = hits.withColumn("score", short_penalty(F.col("score"), F.col(content)))
    return out.orderBy(F.desc("score"), "id") if resort else out


def rerank(hits: DataFrame, query: str, scorer, limit: int, multiplier: int = 5, content: str = "content") -> DataFrame:
    """The best `limit` of hits (id, score, content) by scorer(query, texts) over a pool of limit * multiplier.

    Hits of the pool that the scorer gives no score, and hits outside of it, follow in their own
    order. If the scorer fails the hits' own order stays."""
    pool = hits.orderBy(F.desc("score"), "id").limit(limit * multiplier)

    def run(frames):
        for pdf in frames:
            try:
                pdf = pdf.assign(rerank_score=scorer(query, pdf[content].fillna("").tolist()))
            except Exception:
                pdf = pdf.assign(rerank_score=None)
            yield pdf.astype({"rerank_score": "float64"})

    schema = pool.withColumn("rerank_score", F.lit(None).cast("double")).schema
    scored = pool.coalesce(1).mapInPandas(run, schema)
    return scored.orderBy(F.desc_nulls_last("rerank_score"), F.desc("score"), "id").limit(limit)


def or_by_name(hits: DataFrame, functions: DataFrame, name: str, limit: int) -> DataFrame:
    """hits (id, score, ...), or where there are none the functions of exactly that name, all with score 1."""
    named = functions.where(F.col("name") == name).select("id", F.lit(1.0).alias("score"), F.lit("Graph").alias("source")).orderBy("id").limit(limit)
    return hits.select("id", "score", "source") if not hits.isEmpty() else named
