"""BM25 over chunk tables: postings, ranked search by terms or phrase, type filter, deletes."""

from __future__ import annotations

import re
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_column: str, fields: dict[str, str], tokenizer: str = "code") -> DataFrame:
    """id, field, term, tf, n_tokens of every document. One row per distinct term; made before any shuffle by text.

    fields: field name -> column."""
    parts = [docs.select(F.col(id_column).alias("id"), F.lit(name).alias("field"), tokens(F.col(c), tokenizer).alias("toks")) for name, c in fields.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    sized = every.select("id", "field", F.size("toks").cast("long").alias("n_tokens"), F.explode("toks").alias("term"))
    return sized.groupBy("id", "field", "term", "n_tokens").agg(F.count(F.lit(1)).alias("tf"))


def field_stats(docs: DataFrame, id_column: str, fields: dict[str, str], tokenizer: str = "code") -> DataFrame:
    """field, n_docs, mean_tokens over all documents."""
    parts = [docs.select(F.lit(name).alias("field"), F.size(tokens(F.col(c), tokenizer)).alias("n")) for name, c in fields.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_tokens"))


def postings_of_terms(docs: DataFrame, id_column: str, fields: dict[str, str], terms: list[str], tokenizer: str = "code") -> tuple[DataFrame, DataFrame]:
    """(postings of these terms only, field_stats) from one pass over the texts, which writes a narrow row a document and field."""
    wanted, each = F.array(*map(F.lit, terms)).cast("array<string>"), []
    for name, c in fields.items():
        toks = docs.select(F.col(id_column).alias("id"), F.lit(name).alias("field"), tokens(F.col(c), tokenizer).alias("toks"))
        found = F.transform(wanted, lambda t: F.struct(t.alias("term"), F.size(F.filter("toks", lambda x: x == t)).cast("long").alias("tf")))
        each.append(toks.select("id", "field", F.size("toks").cast("long").alias("n_tokens"), F.filter(found, lambda p: p["tf"] > 0).alias("hits")))
    rows = cut(reduce(DataFrame.unionAll, each))
    stats = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("mean_tokens"))
    return rows.select("id", "field", "n_tokens", F.explode("hits").alias("hit")).select("id", "field", "hit.term", "n_tokens", "hit.tf"), stats


def query_terms(spark, query: str, tokenizer: str) -> list[str]:
    row = spark.range(1).select(tokens(F.lit(query), tokenizer).alias("t")).first()
    return sorted(set(row["t"]))


def scores(post: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """id and score: the sum over fields and terms of idf * tf (k1 + 1) / (tf + k1 (1 - b + b n / mean)).

    Only postings of the query's terms are read; document frequencies come from the same rows."""
    hit = post.where(F.col("term").isin(terms))
    df = hit.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = hit.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens")))
    return weighed.groupBy("id").agg(F.sum(part).alias("score"))


def read_query(query: str) -> tuple[str, bool]:
    """The words to look for, and whether only as a phrase.

    A query in quotes is a phrase. One with an open quote cannot be read; without its operator characters it is
    tried as a phrase where it has several words."""
    quotes, sound = query.count('"'), re.sub(r'["*?]', "", query).strip()
    if quotes % 2 == 0:
        whole = re.fullmatch(r'\s*"([^"]*)"\s*', query)
        return (whole[1], " " in whole[1].strip()) if whole else (re.sub(r'["*?]', " ", query), False)
    return sound, " " in sound


def search(docs: DataFrame, id_column: str, query: str, limit: int, fields: dict[str, str], tokenizer: str = "code", only=None, post: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """id and score of the best `limit` (at least 1) documents for any of the query's terms.

    only: a condition on docs; it filters results, while frequencies are those of the whole corpus.
    post and stats: tables made by postings() and field_stats() before. A phrase (read_query) must stand in one field."""
    spark = docs.sparkSession
    words, as_phrase = read_query(query)
    terms = query_terms(spark, words, tokenizer)
    if post is None or stats is None:
        post, stats = postings_of_terms(docs, id_column, fields, terms, tokenizer)
    found = scores(post, stats, terms)
    if as_phrase:
        held = [phrase(docs, id_column, c, words, tokenizer) for c in fields.values()]
        found = found.join(reduce(DataFrame.unionByName, held).distinct(), "id", "left_semi")
    if only is not None:
        found = found.join(docs.where(only).select(F.col(id_column).alias("id")), "id", "left_semi")
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(max(limit, 1))


def phrase(docs: DataFrame, id_column: str, column: str, query: str, tokenizer: str = "code") -> DataFrame:
    """Ids of documents that hold the query's tokens one after the other."""
    row = docs.sparkSession.range(1).select(tokens(F.lit(query), tokenizer).alias("t")).first()
    want = row["t"]
    sep = "\x1f"
    joined = F.concat(F.lit(sep), F.array_join(tokens(F.col(column), tokenizer), sep), F.lit(sep))
    return docs.where(F.contains(joined, F.lit(sep + sep.join(want) + sep)) & F.lit(bool(want))).select(F.col(id_column).alias("id"))


def delete_paths(table: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """The table without the rows of the given paths (path)."""
    return table.join(paths.select(F.col("path").alias(column)).distinct(), column, "left_anti").select(*table.columns)


def document_count(stats: DataFrame) -> int:
    """How many documents an index holds, from its field statistics."""
    return stats.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]


class TextSearchProvider(Protocol):
    """Anything that can be the sparse channel: an index that takes chunks and answers with id and score, best first."""

    def index_chunks(self, chunks: DataFrame) -> None: ...

    def search(self, query: str, limit: int) -> DataFrame: ...

    def remove_by_path(self, path: str) -> None: ...

    def is_ready(self) -> bool: ...

    def document_count(self) -> int: ...


class TableSearch:
    """A TextSearchProvider over a chunk table (snippet_id, file_path, and the fields' columns)."""

    def __init__(self, fields: dict[str, str], tokenizer: str = "code", chunks: DataFrame | None = None):
        self.fields, self.tokenizer, self.chunks = fields, tokenizer, chunks

    def index_chunks(self, chunks: DataFrame) -> None:
        """Adds chunks; those of an id that is there already are replaced."""
        kept = None if self.chunks is None else self.chunks.join(chunks.select("snippet_id").distinct(), "snippet_id", "left_anti")
        self.chunks = chunks if kept is None else kept.unionByName(chunks)

    def search(self, query: str, limit: int) -> DataFrame:
        return search(self.chunks, "snippet_id", query, limit, self.fields, self.tokenizer)

    def remove_by_path(self, path: str) -> None:
        self.chunks = self.chunks.where(F.col("file_path") != path)

    def is_ready(self) -> bool:
        return self.chunks is not None

    def document_count(self) -> int:
        return 0 if self.chunks is None else self.chunks.count()
