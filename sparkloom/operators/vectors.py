"""Embedding providers, a content-addressed cache and exact nearest neighbours."""

from __future__ import annotations

import hashlib
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_bytes
from ..session import cut


class EmbeddingProvider(Protocol):
    """Anything that turns texts into vectors; it must pickle."""

    model: str
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """A deterministic local provider: signed hashed character trigrams and words, scaled to length 1.

    Trigrams are told apart by their code points; each distinct one of a call is hashed once, and most_known of them are remembered."""

    def __init__(self, dims: int = 64, model: str = "hashing-v1", most_known: int = 200_000):
        self.dims, self.model, self.most_known, self.known = dims, model, most_known, {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def slot(self, x: str) -> int:
        """Twice the place of x in a vector, and 1 if it counts down."""
        got = self.known.get(x)
        if got is None:
            h = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            if len(self.known) >= self.most_known:
                self.known.clear()
            got = self.known[x] = h % self.dims * 2 + (h >> 63 ^ 1)
        return got

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        sums = np.zeros((len(texts), 2 * self.dims))
        keys, of = [], []
        for i, text in enumerate(texts):
            low = text.lower()
            words = [self.slot(x) for x in low.split()]
            if words:
                sums[i] += np.bincount(words, minlength=2 * self.dims)
            c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if len(c) > 2:
                keys.append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
                of.append(np.full(len(c) - 2, i))
        if keys:
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            slots = np.array([self.slot(chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF)) for k in found.tolist()])
            flat = np.concatenate(of) * (2 * self.dims) + slots[at]
            sums += np.bincount(flat, minlength=sums.size).reshape(sums.shape)
        v = sums[:, 0::2] - sums[:, 1::2]
        norms = [x**0.5 or 1.0 for x in (v * v).sum(1).tolist()]
        return (v / np.array(norms).reshape(-1, 1)).tolist()


def embed(df: DataFrame, provider: EmbeddingProvider, text: str, batch: int = 20, batch_bytes: int = 4 << 20) -> DataFrame:
    """df with `vector`; texts go to the provider in batches, whose counts are checked.

    A Python worker turns slices of about batch_bytes of an Arrow batch into text objects, not the whole batch."""
    from pyspark.sql.types import ArrayType, FloatType, StructField

    shown = df.withColumn(text, truncate_bytes(F.col(text)))
    schema = type(shown.schema)([*(f for f in shown.schema if f.name != "vector"), StructField("vector", ArrayType(FloatType()))])
    names = [f.name for f in schema][:-1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            b = b.select(names)
            rows = max(batch, batch_bytes * max(1, b.num_rows) // max(1, b.nbytes) // batch * batch)
            for a in range(0, b.num_rows, rows):
                part, vectors = b.slice(a, rows), []
                texts = ["" if t is None else t for t in part.column(names.index(text)).to_pylist()]
                for i in range(0, len(texts), batch):
                    got = provider.embed(texts[i : i + batch])
                    if len(got) != len(texts[i : i + batch]):
                        raise ValueError("the provider returned another number of vectors than texts")
                    vectors.append(pa.array(got, pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.concat_arrays(vectors)], names=[*names, "vector"])

    return shown.mapInArrow(run, schema)


def cache_key(model: str, text):
    return F.md5(F.concat(F.lit(model), F.coalesce(text, F.lit(""))).cast("binary"))


def cache_misses(chunks: DataFrame, cache: DataFrame, model: str, text: str = "content") -> DataFrame:
    """The distinct texts, with hash, that the cache lacks."""
    keyed = chunks.select(cache_key(model, F.col(text)).alias("hash"), F.col(text))
    return keyed.groupBy("hash").agg(F.first(text).alias(text)).join(cache.select("hash").distinct(), "hash", "left_anti")


def embed_cached(chunks: DataFrame, cache: DataFrame, provider: EmbeddingProvider, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(chunks with vector, new cache rows). Only texts that the cache lacks are embedded, once: their vectors are written."""
    fresh = cut(embed(cache_misses(chunks, cache, provider.model, text), provider, text).select("hash", "vector"))
    every = cache.select("hash", "vector").unionByName(fresh)
    out = chunks.withColumn("hash", cache_key(provider.model, F.col(text))).join(every, "hash").drop("hash")
    return out, fresh


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def of_dims(vectors: DataFrame, dims: int, column: str = "vector") -> DataFrame:
    """Rows whose vector has the right length; nulls are dropped as well."""
    return vectors.where(F.size(column) == dims)


def knn(vectors: DataFrame, query: list[float], k: int, id_column: str = "id", column: str = "vector") -> DataFrame:
    """The k nearest rows by squared distance, with distance and score 1 / (1 + distance); ties by id.

    The query is a literal: one narrow pass and a top-k that is merged from each task's."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = of_dims(vectors, len(query), column).withColumn("distance", squared_distance(F.col(column), q))
    return near.withColumn("score", 1 / (1 + F.col("distance"))).orderBy(F.round("distance", 9), id_column).limit(k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, block_bytes: int = 64 << 20, salts: int = 32) -> DataFrame:
    """query_id, id, distance, rank: the k nearest of `vectors` (id, vector) for each of `queries` (query_id, vector); ties of distances rounded to 9 digits by id.

    Queries are broadcast in blocks of at most block_bytes, each of which takes one pass over the vectors. A task
    keeps the k best of its whole partition for every query of the block, and only these are shuffled: first
    among the tasks of a salt, then among salts, so that no task gathers more than its share of the tasks' bests."""
    spark, kinds = queries.sparkSession, (queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())
    dims = queries.select(F.max(F.size("vector"))).first()[0]
    ddl = f"query_id {kinds[0]}, id {kinds[1]}, distance double, salt int"
    out = spark.createDataFrame([], ddl)
    if dims:
        asked, each = of_dims(queries.select("query_id", "vector"), dims), max(1, block_bytes // (8 * dims))
        blocks = -(-asked.count() // each)
        for i in range(blocks):
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            out = out.unionByName(nearest_of_block(part, of_dims(vectors, dims), k, salts, ddl))
    top = lambda df, *by: df.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round("distance", 9).alias("near"), "id", "distance"))), 1, k).alias("best"))
    first = top(out, "query_id", "salt").select("query_id", F.explode("best").alias("b")).select("query_id", "b.id", "b.distance")
    return top(first, "query_id").select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", "b.id", "b.distance", (F.col("rank") + 1).alias("rank"))


def nearest_of_block(queries: DataFrame, vectors: DataFrame, k: int, salts: int, ddl: str, rows: int = 512, columns: int = 2048) -> DataFrame:
    """The k best rows of every partition of vectors for every query, by distance rounded to 9 digits, then id.

    Distances are made for rows queries and columns vectors at a time, whatever the batches' sizes; only pairs that
    may be among the best are kept, and theirs are made again from differences, so that equal vectors are equally far."""
    import numpy as np

    got = queries.toPandas()
    if got.empty:
        return queries.sparkSession.createDataFrame([], ddl)
    shared = queries.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(), np.stack(got["vector"].to_numpy()).astype(np.float64)))

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        ids, q = shared.value
        best_d, best_id, q2 = np.full((len(q), k), np.inf), None, (q * q).sum(1)
        for pdf in frames:
            for start in range(0, len(pdf), columns):
                x = np.stack(pdf["vector"].iloc[start : start + columns].to_numpy()).astype(np.float64)
                own, x2 = pdf["id"].iloc[start : start + columns].to_numpy(), (x * x).sum(1)
                if best_id is None:
                    best_id = np.empty((len(q), k), dtype=own.dtype)
                for a in range(0, len(q), rows):
                    d = q2[a : a + rows, None] - 2 * q[a : a + rows] @ x.T + x2[None, :]
                    slack = 1e-8 + 1e-9 * (q2[a : a + rows] + x2.max())
                    bar = best_d[a : a + rows].max(1)
                    if d.shape[1] > k:
                        bar = np.minimum(bar, np.partition(d, k - 1, axis=1)[:, k - 1]) if np.isinf(bar).any() else bar
                    near = d <= (bar + slack)[:, None]
                    for i in np.flatnonzero(near.any(1)):
                        at, r = np.flatnonzero(near[i]), a + i
                        both = np.concatenate((best_d[r], ((x[at] - q[r]) ** 2).sum(1)))
                        names = np.concatenate((best_id[r], own[at]))
                        keep = np.isfinite(both)
                        both, names = both[keep], names[keep]
                        first = np.lexsort((names, np.round(both, 9)))[:k]
                        best_d[r, : len(first)], best_id[r, : len(first)] = both[first], names[first]
        if best_id is not None:
            keep = np.isfinite(best_d)
            yield pd.DataFrame({"query_id": np.repeat(ids, keep.sum(1)), "id": best_id[keep], "distance": best_d[keep], "salt": TaskContext.get().partitionId() % salts})

    return vectors.select("id", "vector").mapInPandas(run, ddl)


def drop_vanished(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits whose file still exists; applied after the top-k, so fewer than k may stay."""
    return hits.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
