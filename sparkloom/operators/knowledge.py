"""A small typed knowledge base: create, filter, delete and hybrid search over record tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KNOWLEDGE
from ..session import cut
from . import bm25, fusion, incremental, vectors

# What a record's type and source may be, and the type of a domain.
TYPES = ("repo_retrieval", "coding_modification")
SOURCES = ("repo_agent", "coding_agent")
DOMAINS = {"repo": "repo_retrieval", "coding": "coding_modification"}
_sequence = count(1)


def record_id(millis: int) -> str:
    return f"kn_{millis}_{next(_sequence)}"


def sanitise(df: DataFrame) -> DataFrame:
    """Titles of at most 30 and contents of at most 500 characters."""
    return df.withColumn("title", F.substring("title", 1, 30)).withColumn("content", F.substring("content", 1, 500))


def types_of(domains) -> list[str]:
    """The record types of domains; a name that is no domain stands for itself."""
    return sorted({DOMAINS.get(d, d) for d in domains})


def embed_text():
    return F.concat_ws(" ", "title", "content")


VECTORS = "id string, vector array<float>"


class KnowledgeBase:
    """Records and their vectors; a record is embedded once, when it is added.

    With a store, a folder, every change is a new version of both tables under the writers' lock, and others see it when
    they open the folder. Without one they are DataFrames of this object, cut after every change."""

    def __init__(self, spark: SparkSession, records: DataFrame | None = None, provider=None, types=TYPES, store: str | None = None):
        self.spark, self.types = spark, types
        self.provider = provider or vectors.HashingProvider()
        self.store = incremental.Snapshots(spark, store) if store else None
        self._vectors: DataFrame | None = None
        if self.store:
            self.reload()
        else:
            self.records = records if records is not None else spark.createDataFrame([], KNOWLEDGE)
        if self.store and records is not None:
            self.add_records(records)

    def reload(self) -> None:
        """The store's current version."""
        self.records, self._vectors = self.store.read("records", KNOWLEDGE), self.store.read("vectors", VECTORS)

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            self._vectors = cut(self.embedded(self.records))
        return self._vectors

    def embedded(self, records: DataFrame) -> DataFrame:
        return vectors.embed(records.select("id", embed_text().alias("text")), self.provider, "text").select("id", "vector")

    def keep(self, change) -> None:
        """Applies change(records, vectors) to the current tables and makes the result current."""
        if not self.store:
            self.records, self._vectors = map(cut, change(self.records, self.vectors))
            return
        with self.store.exclusive():
            self.reload()
            records, kept = change(self.records, self.vectors)
            self.store.write({"records": records, "vectors": kept})
        self.reload()

    def add_records(self, records: DataFrame) -> None:
        """Adds rows of KNOWLEDGE."""
        fresh = cut(sanitise(records))
        self.keep(lambda r, v: (r.unionByName(fresh), v.unionByName(self.embedded(fresh))))

    def add(self, title: str, content: str, type: str, now_millis: int, tags=(), related_files=(), parent_ids=(), source_agent: str = "repo_agent", task_id: str | None = None, confidence: float = 0.8) -> str:
        if type not in self.types:
            raise ValueError(f"type must be one of {', '.join(self.types)}")
        if source_agent not in SOURCES:
            raise ValueError(f"source_agent must be one of {', '.join(SOURCES)}")
        rid, stamp = record_id(now_millis), self.spark.range(1).select(F.timestamp_millis(F.lit(now_millis)).cast("string")).first()[0]
        row = (rid, title, content, type, list(tags), list(related_files), source_agent, task_id, float(confidence), 0, stamp, stamp, None, list(parent_ids))
        self.add_records(self.spark.createDataFrame([row], KNOWLEDGE))
        return rid

    def delete(self, rid: str) -> None:
        self.keep(lambda r, v: (r.where(F.col("id") != rid), v.where(F.col("id") != rid)))

    def list(self, limit: int = 50, type: str | None = None, tag: str | None = None) -> DataFrame:
        """Filters first, so that no match is missed, then the newest `limit`."""
        out = self.records
        if type is not None:
            out = out.where(F.col("type") == type)
        if tag is not None:
            out = out.where(F.array_contains("tags", tag))
        return out.orderBy(F.desc("created_at"), "id").limit(limit)

    def search(self, query: str, limit: int = 8, domains=()) -> DataFrame:
        """Records with score, dense_score and sparse_score, from both channels of 4 * limit hits each."""
        if not query.strip():
            return self.records.limit(0).withColumn("score", F.lit(0.0)).withColumn("dense_score", F.lit(0.0)).withColumn("sparse_score", F.lit(0.0))
        only = F.col("type").isin(types_of(domains)) if domains else None
        inside = self.vectors if only is None else self.vectors.join(self.records.where(only).select("id"), "id", "left_semi")
        sparse = bm25.search(self.records, "id", query, 4 * limit, {"title": "title", "content": "content"}, only=only)
        dense = vectors.knn(inside, self.provider.embed([query])[0], 4 * limit).select("id", "score")
        fused = fusion.rrf([fusion.ranked(dense, "dense", [F.desc("score"), "id"]), fusion.ranked(sparse, "sparse", [F.desc("score"), "id"])])
        best = fused.orderBy(F.desc("score"), "id").limit(limit)
        scores = best.join(dense.withColumnRenamed("score", "dense_score"), "id", "left").join(sparse.withColumnRenamed("score", "sparse_score"), "id", "left")
        return self.records.join(scores.drop("source"), "id").orderBy(F.desc("score"), "id")
