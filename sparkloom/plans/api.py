"""The engine's entry points over an index: build, status, search, callers, call graphs, skeletons, snippets, projects.

An index is a folder of versioned tables (see operators.incremental.Snapshots). Building it again
looks at file hashes first and extracts only files that are new or changed."""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.detect import skip_compiled
from ..functions.text import line_range
from ..operators import bm25, extract, fusion, graph, incremental, resolve, skeleton, vectors
from ..session import cut
from ..sources import files as sources
from ..streaming import watch

#: So long an index keeps its old versions, for readers that hold them.
KEEP_SECONDS = 3600.0
FIELDS = {"content": "content", "symbol_name": "symbol_name"}
POSTINGS = "id string, field string, term string, n_tokens long, tf long"


@dataclasses.dataclass
class IndexStats:
    version: str
    new: int
    changed: int
    unchanged: int
    deleted: int


class Index:
    """An opened index: its tables by name, of the current version."""

    def __init__(self, spark: SparkSession, out: str, config: sources.Config | None = None, provider=None):
        self.spark, self.store, self.config = spark, incremental.Snapshots(spark, out), config or sources.Config()
        self.provider = provider or vectors.HashingProvider(self.config.embedding_dims)

    def __getattr__(self, name: str) -> DataFrame:
        kinds = {"files": schemas.FILES, "functions": None, "calls": schemas.CALLS, "classes": None, "symbols": extract.SYMBOLS, "chunks": schemas.CHUNKS, "vectors": schemas.VECTORS, "cache": "hash string, vector array<float>", "hashes": schemas.HASHES, "postings": POSTINGS, "field_stats": "field string, n_docs long, mean_tokens double"}
        if name not in kinds:
            raise AttributeError(name)
        ddl = kinds[name] or {"functions": schemas.FUNCTIONS, "classes": schemas.CLASSES}[name]
        return self.store.read(name, ddl)


def build_index(spark: SparkSession, root: str | DataFrame, out: str, config: sources.Config | None = None, provider=None) -> IndexStats:
    """Scans root (a folder, or a FILES table), updates the index in out and publishes a new version.

    Extraction and embedding run for new and changed texts only; postings, chunks and calls are made
    anew from the symbols, which takes no parsing; deletes reach every
    table. Calls are resolved anew, as a name's target may have moved to another file. One builder at a time:
    another one waits for the lock of the index; readers keep the version that they opened."""
    index = Index(spark, out, config, provider)
    with index.store.exclusive():
        return update(index, root)


def update(index: Index, root: str | DataFrame) -> IndexStats:
    spark = index.spark
    scanned = sources.scan(spark, root) if isinstance(root, str) else root
    found = skip_compiled(scanned).select("path", "content", "md5", "size", "language", "mtime")
    status = incremental.classify(index.hashes, incremental.hashes(found)).cache()
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    fresh_paths = status.where("status in ('new', 'changed')").select("path")
    stale = status.where("status <> 'unchanged'").select("path")
    fresh = found.join(fresh_paths, "path", "left_semi")
    new_symbols = extract.extract(fresh)
    symbols = incremental.replace_files(index.symbols, new_symbols, stale)
    files = incremental.replace_files(index.files, fresh, stale, "path")
    version_tables = {"files": files, "symbols": symbols, "hashes": incremental.hashes(files)}
    staged = incremental.Snapshots(spark, f"{index.store.root}/staging-{uuid.uuid4().hex[:12]}")
    staged.write(version_tables)
    files, symbols, hashes = (staged.read(n) for n in ("files", "symbols", "hashes"))
    functions, classes = extract.functions_of(symbols, files), extract.classes_of(symbols, files)
    calls = resolve.build_calls(extract.call_sites(symbols), functions)
    chunks = extract.chunks_of(symbols, index.config.min_chunk_chars)
    embedded, added = vectors.embed_cached(chunks.select(F.col("snippet_id").alias("id"), "content"), index.cache, index.provider)
    tables = {"files": files, "symbols": symbols, "hashes": hashes, "functions": functions, "classes": classes, "calls": calls, "chunks": chunks, "vectors": incremental.compact(cut(embedded.select("id", "vector"))), "cache": index.cache.unionByName(added)}
    post = bm25.postings(chunks, "snippet_id", FIELDS, index.config.tokenizer)
    tables["postings"] = post.repartitionByRange("term").sortWithinPartitions("term")  # a term's rows lie in few row groups
    tables["field_stats"] = bm25.field_stats(chunks, "snippet_id", FIELDS, index.config.tokenizer)
    version = index.store.write(tables)
    staged.drop()
    index.store.prune(KEEP_SECONDS)
    return IndexStats(version, *(counts.get(k, 0) for k in ("new", "changed", "unchanged", "deleted")))


def status(index: Index, root: str = "") -> DataFrame:
    """One row: root, hash, index_dir, total_functions, total_files, indexed."""
    n = index.functions.agg(F.count(F.lit(1)).alias("total_functions"))
    m = index.files.agg(F.count(F.lit(1)).alias("total_files"))
    one = lambda df: df.withColumn("k", F.lit(1))
    out = one(n).join(one(m), "k").drop("k")
    return out.select(F.lit(root).alias("root"), F.lit(sources.project_id(root)).alias("hash"), F.lit(index.store.root).alias("index_dir"), "total_functions", "total_files", F.lit(index.store.current() is not None).alias("indexed"))


def search(index: Index, query: str, limit: int = 10, tokenizer: str | None = None, rerank=None, text_search: bm25.TextSearchProvider | None = None, present: DataFrame | None = None) -> DataFrame:
    """Fused hits: id, score, source and the chunk's columns, best first; functions of that name where nothing hits.

    text_search takes the place of the index's own sparse channel; where that fails, dense hits keep their own scores.
    present: the files (path) that still exist; dense hits in others are dropped behind the top-k."""
    c, chunks = index.config, index.chunks
    pool = max(c.channel_limit, limit)
    dense = vectors.knn(index.vectors, index.provider.embed([query])[0], pool).select("id", "score")
    if present is not None:
        dense = vectors.drop_vanished(dense.join(chunks.select(F.col("snippet_id").alias("id"), "file_path"), "id"), present).select("id", "score")
    built = tokenizer in (None, c.tokenizer)  # else the postings of the other tokenizer are made now
    own = lambda: bm25.search(chunks, "snippet_id", query, pool, FIELDS, tokenizer or c.tokenizer, post=index.postings if built else None, stats=index.field_stats if built else None)
    given = lambda: text_search.search(query, pool).select("id", "score").limit(pool)
    dense, sparse = fusion.dense_and(dense, given if text_search is not None else own)
    order = [F.desc(F.round("score", 9)), "id"]
    if sparse is None:
        fused = fusion.dense_only(dense)
    else:
        fused = fusion.rrf([fusion.ranked(dense, "dense", order), fusion.ranked(sparse, "sparse", order)], c.rrf_k)
    if c.rrf_top_k:
        fused = fused.orderBy(F.desc("score"), "id").limit(c.rrf_top_k)
    hits = fused.join(chunks.withColumnRenamed("snippet_id", "id"), "id")
    if hits.isEmpty():
        named = graph.find_by_name(index.functions, query)
        return named.select("id", F.lit(1.0).alias("score"), F.lit("Graph").alias("source"), "file_path", F.col("name").alias("symbol_name"), "language", "line_start", "line_end").orderBy("file_path", "line_start").limit(limit)
    hits = fusion.penalise_short(hits)
    if rerank is not None:
        return fusion.rerank(hits, query, rerank, limit, c.rerank_pool_multiplier)
    return hits.limit(limit)


def callers(index: Index, symbol: str) -> DataFrame:
    return graph.callers(index.calls, index.functions, symbol)


def callees(index: Index, symbol: str) -> DataFrame:
    return graph.callees(index.calls, index.functions, symbol)


def callgraph(index: Index, symbol: str, depth: int = 1, mode: str = "bfs"):
    """mode bfs: a table id, name, direction, depth; mode dfs_tree: {function_name, depth, center, callers, callees} or {}."""
    if mode == "dfs_tree":
        down, up = (graph.call_tree(index.calls, index.functions, symbol, depth, d) for d in ("callees", "callers"))
        return {"function_name": symbol, "depth": depth, "center": down["name"], "callers": up["children"], "callees": down["children"]} if down else {}
    start = graph.find_by_name(index.functions, symbol).orderBy("file_path", "line_start", "id").limit(1).select("id")
    both = [graph.bfs(index.calls, start, depth, d).withColumn("direction", F.lit(d)) for d in ("callees", "callers")]
    return both[0].unionByName(both[1]).where("depth > 0").join(index.functions.select("id", "name", "file_path"), "id")


def skeletons(index: Index, paths: list[str]) -> DataFrame:
    return skeleton.batch_json(index.symbols, index.spark.createDataFrame([(p,) for p in paths], "path string"))


def snippet(index: Index, name: str, path: str | None = None) -> dict:
    """The text of a function; a path, or a part of one from its end, tells functions of one name apart."""
    found = graph.find_by_name(index.functions, name)
    if path is not None:
        found = found.where(F.col("file_path").endswith(path) | F.lit(path).endswith(F.col("file_path")))
    rows = found.orderBy("file_path", "line_start").limit(20).collect()
    if not rows:
        return {"success": False, "error": f"function {name} not found"}
    if len({r["file_path"] for r in rows}) > 1:
        return {"success": False, "error": "ambiguous; give one of: " + ", ".join(sorted({r["file_path"] for r in rows}))}
    r = rows[0]
    text = index.files.where(F.col("path") == r["file_path"]).select(F.array_join(F.slice(F.split("content", "\n"), r["line_start"], r["line_end"] - r["line_start"] + 1), "\n")).first()[0]
    return {"success": True, "data": {"filepath": r["file_path"], "function_name": name, "code_snippet": text, "line_start": r["line_start"], "line_end": r["line_end"], "language": r["language"]}}


def neighbour_snippets(index: Index, symbol: str, direction: str = "callers") -> DataFrame:
    """name, file_path, line_start, line_end and text of the callers or callees of a symbol."""
    near = graph.neighbours(index.calls, index.functions, graph.find_by_name(index.functions, symbol), direction)
    rows = near.select("id", "name", "file_path", "line_start", "line_end").distinct()
    text = index.files.select(F.col("path").alias("file_path"), "content")
    return rows.join(text, "file_path").select("name", "file_path", "line_start", "line_end", line_range(F.col("content"), F.col("line_start"), F.col("line_end")).alias("code_snippet"))


def warm(index: Index, n: int = 1000) -> DataFrame:
    """name, file_path, line_start and text of the first n functions by file and line, cached for repeated look-ups."""
    first = index.functions.orderBy("file_path", "line_start", "id").limit(n).select("name", "file_path", "line_start", "line_end")
    text = index.files.select(F.col("path").alias("file_path"), "content")
    snippets = first.join(text, "file_path").select("name", "file_path", "line_start", line_range(F.col("content"), F.col("line_start"), F.col("line_end")).alias("code_snippet"))
    return snippets.cache()


def search_entities(index: Index, name: str) -> DataFrame:
    """Functions and classes of a name, with kind."""
    columns = ["id", "name", "file_path", "line_start", "line_end", "language"]
    return graph.entities(index.functions.select(*columns), index.classes.select(*columns), name)


def repository_stats(index: Index) -> DataFrame:
    """One row: the graph's totals, and how many classes there are of each type."""
    kinds = index.classes.groupBy("class_type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_type", "count")))).alias("classes"))
    return graph.stats(index.calls, index.functions).withColumn("k", F.lit(1)).join(kinds.withColumn("k", F.lit(1)), "k").drop("k")


def watch_index(spark: SparkSession, root: str, out: str, events: str, checkpoint: str):
    """A streaming query that builds the index anew after every burst of event files in `events`.

    Building looks at hashes, so a repeated micro-batch does nothing."""
    bursts = watch.debounce_stream(watch.read_events(spark, events))
    return watch.on_burst(bursts, lambda batch, batch_id: build_index(spark, root, out), checkpoint)


def projects(spark: SparkSession, home: str) -> DataFrame:
    """project, index_dir, version and size_bytes of every index in the folders of home."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(home)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for f in fs.listStatus(base) if fs.exists(base) else []:
        store = incremental.Snapshots(spark, f.getPath().toString())
        if f.isDirectory() and (v := store.current()) is not None:
            size = fs.getContentSummary(store._path(f"{store.root}/v-{v}")).getLength()
            rows.append((f.getPath().getName(), store.root, v, size))
    return spark.createDataFrame(rows, "project string, index_dir string, version string, size_bytes long")


def drop_index(spark: SparkSession, out: str) -> None:
    incremental.Snapshots(spark, out).drop()


def as_json(df: DataFrame) -> str:
    """A small result as a JSON array, scores rounded to 3 digits."""
    cols = [F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct(*cols))).collect()])
