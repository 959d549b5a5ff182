"""The engine's operators on the shared tables, one query each, with equivalent SQL.

Projection of the code model: a part is a function (name p_name, file p_brand, language p_type), and
consecutive lines of an order, in a total order, are a call from one part to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import text as X
from ..operators import bm25, evaluate, export, fusion, graph, incremental, resolve, vectors
from ..streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions_of(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("language"), F.col("p_size").alias("line_start"), (F.col("p_size") + 5).alias("line_end")
    )


def calls_of(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("caller_id"), F.lead("l_partkey").over(w).alias("callee_id"))
    return lines.where("callee_id is not null").select("caller_id", "callee_id", F.col("l_orderkey").alias("line_number"))


CALLS = """calls AS (
  SELECT caller_id, callee_id, line_number FROM (
    SELECT l_partkey AS caller_id, l_orderkey AS line_number,
           lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS callee_id
    FROM lineitem) WHERE callee_id IS NOT NULL)"""
DISTANCE = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
SYMBOL = "SELECT min(p_name) AS s FROM part"


def symbol_of(spark, d) -> str:
    return table(spark, d, "part").agg(F.min("p_name")).first()[0]


def probe(spark, d) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def vectors_of(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


# Vectors


@query(f"""SELECT e.vec_id AS id, round({DISTANCE}, 6) AS distance, round(1 / (1 + {DISTANCE}), 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY round({DISTANCE}, 9), e.vec_id LIMIT 20""")
def knn_topk(spark, d):
    return vectors.knn(vectors_of(spark, d), probe(spark, d), 20).select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("SELECT label, CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE len(embedding) = 64 GROUP BY label")
def knn_dim_filter(spark, d):
    return vectors.of_dims(vectors_of(spark, d), 64).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM (
  SELECT q.query_id, e.vec_id AS id, {DISTANCE} AS distance, row_number() OVER (PARTITION BY q.query_id ORDER BY round({DISTANCE}, 9), e.vec_id) AS rank
  FROM embeddings e, q) WHERE rank <= 5""")
def knn_join(spark, d):
    v = vectors_of(spark, d)
    found = vectors.knn_join(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), v, 5)
    return found.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


# Text


TOKENS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda t: length(t) <= 40)"
CODE_TOKENS = r"""list_transform(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+'),
  lambda w: CASE WHEN len(list_filter(regexp_extract_all(w, '[A-Z]?[^A-Z_]+|[A-Z]'), lambda p: p <> '')) > 1
  THEN list_concat(list_filter(regexp_extract_all(w, '[A-Z]?[^A-Z_]+|[A-Z]'), lambda p: p <> ''), [w])
  ELSE list_filter(regexp_extract_all(w, '[A-Z]?[^A-Z_]+|[A-Z]'), lambda p: p <> '') END)), lambda t: lower(t))"""


def token_counts(spark, d, tokenizer):
    t = table(spark, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"), tokenizer)).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


@query(f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def tokens_df(spark, d):
    return token_counts(spark, d, "default")


@query(f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({CODE_TOKENS}) AS term FROM documents) GROUP BY term")
def code_tokens_df(spark, d):
    return token_counts(spark, d, "code")


BM25 = f"""tok AS (SELECT doc_id, lang, source, {TOKENS} AS t FROM documents),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean FROM tok),
ps AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) WHERE term IN ('the', 'que', 'der', 'with') GROUP BY doc_id, dl, term),
dfs AS (SELECT term, count(*) AS df FROM ps GROUP BY term),
sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM ps JOIN dfs USING (term), st GROUP BY doc_id)"""


def bm25_docs(spark, d, limit, only=None, docs=None):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source") if docs is None else docs
    return bm25.search(docs, "doc_id", "the que der with", limit, {"content": "text"}, "default", only)


@query(f"WITH {BM25} SELECT doc_id AS id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def bm25_topk(spark, d):
    return bm25_docs(spark, d, 50).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id AS id, round(score, 6) AS score FROM sc JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE lang IN ('de', 'fr') ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def bm25_type_filter(spark, d):
    return bm25_docs(spark, d, 50, F.col("lang").isin("de", "fr")).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25.replace('FROM documents)', "FROM documents WHERE source <> 'src0')", 1)} SELECT doc_id AS id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def bm25_delete_path(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    gone = spark.createDataFrame([("src0",)], "path string")
    return bm25_docs(spark, d, 50, docs=bm25.delete_paths(docs, gone, "source")).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id AS id FROM documents WHERE concat(' ', array_to_string({TOKENS}, ' '), ' ') LIKE '% of the %'")
def bm25_phrase(spark, d):
    return bm25.phrase(table(spark, d, "documents"), "doc_id", "text", "of the", "default")


@query("""SELECT doc_id, CAST(length(trim(text, E' \\t\\n\\r\\x0b\\x0c')) >= 16 AS BOOLEAN) AS long_enough, round(CASE WHEN length(trim(text, '""" + X.WHITE + """')) < 30 THEN 1 - (1 - length(trim(text, '""" + X.WHITE + """')) / 30.0) * 0.5 ELSE 1.0 END, 6) AS weight FROM documents""")
def short_penalty(spark, d):
    return table(spark, d, "documents").select("doc_id", X.long_enough(F.col("text")).alias("long_enough"), F.round(X.short_penalty(F.lit(1.0), F.col("text")), 6).alias("weight"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS snippet FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def snippet_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", X.line_range(F.col("text"), F.lit(2), F.lit(3)).alias("snippet")).where("snippet is not null")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE length(trim(text, E' \\t\\n\\r\\x0b\\x0c')) >= 16 GROUP BY lang")
def chunk_filter(spark, d):
    return table(spark, d, "documents").where(X.long_enough(F.col("text"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, CASE WHEN n = '' THEN 'global' ELSE n END AS namespace FROM (
  SELECT page_id, trim(regexp_extract(coalesce(html, ''), '(?m)^\s*(?:inline\s+)?namespace\s+([\w:]+)', 1)) AS n FROM pages)""")
def namespace_first_line(spark, d):
    return table(spark, d, "pages").select("page_id", X.namespace(F.coalesce("html", F.lit("")), F.lit("cpp")).alias("namespace"))


# Fusion


RRF = f"""dn AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY round({DISTANCE}, 9), e.vec_id) AS rank
  FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q QUALIFY rank <= 100),
sp AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 100),
fu AS (SELECT id, coalesce(1 / (60.0 + dn.rank), 0) + coalesce(1 / (60.0 + sp.rank), 0) AS score, dn.rank IS NOT NULL AS d, sp.rank IS NOT NULL AS s FROM dn FULL JOIN sp USING (id))"""


def channels(spark, d):
    dense = vectors.knn(vectors_of(spark, d), probe(spark, d), 100)
    return fusion.ranked(dense, "dense", [F.round("distance", 9), "id"]), fusion.ranked(bm25_docs(spark, d, 100), "sparse", [F.desc(F.round("score", 9)), "id"])


@query(f"WITH {BM25}, {RRF} SELECT id, round(score, 6) AS score, CASE WHEN d AND s THEN 'Fused' WHEN d THEN 'DenseOnly' ELSE 'SparseOnly' END AS source FROM fu")
def rrf_fuse(spark, d):
    return fusion.rrf(list(channels(spark, d))).withColumn("score", F.round("score", 6))


@query(f"WITH {BM25}, {RRF.replace('coalesce(1 / (60.0 + dn.rank), 0) + coalesce(1 / (60.0 + sp.rank), 0)', 'coalesce(2 / (10.0 + dn.rank), 0) + coalesce(1 / (10.0 + sp.rank), 0)')} SELECT id, round(score, 6) AS score FROM fu ORDER BY round(score, 9) DESC, id LIMIT 20")
def rrf_weights_k(spark, d):
    return fusion.rrf(list(channels(spark, d)), 10, {"dense": 2.0}).orderBy(F.desc(F.round("score", 9)), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25}, {RRF} SELECT fu.id, round(CASE WHEN length(trim(text)) < 30 THEN score * (1 - (1 - length(trim(text)) / 30.0) * 0.5) ELSE score END, 6) AS score FROM fu JOIN documents ON doc_id = fu.id")
def hybrid_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    hits = fusion.rrf(list(channels(spark, d))).join(docs, "id")
    return fusion.penalise_short(hits).select("id", F.round("score", 6).alias("score"))


@query(f"WITH s AS ({SYMBOL}) SELECT p_partkey AS id, 1.0::DOUBLE AS score, 'Graph' AS source FROM part, s WHERE p_name = s ORDER BY 1 LIMIT 10")
def hybrid_fallback_name(spark, d):
    none = spark.createDataFrame([], "id long, score double, source string")
    return fusion.or_by_name(none, functions_of(spark, d), symbol_of(spark, d), 10)


# Graph


@query(f"WITH {CALLS}, s AS ({SYMBOL}) SELECT a.p_name AS caller, a.p_brand AS caller_file, line_number AS caller_line, s AS target FROM calls JOIN part b ON callee_id = b.p_partkey JOIN s ON b.p_name = s JOIN part a ON caller_id = a.p_partkey")
def callers(spark, d):
    return graph.callers(calls_of(spark, d), functions_of(spark, d), symbol_of(spark, d))


@query(f"WITH {CALLS}, s AS ({SYMBOL}) SELECT b.p_name AS callee, b.p_brand AS callee_file, b.p_size AS callee_line, s AS caller FROM calls JOIN part a ON caller_id = a.p_partkey JOIN s ON a.p_name = s JOIN part b ON callee_id = b.p_partkey")
def callees(spark, d):
    return graph.callees(calls_of(spark, d), functions_of(spark, d), symbol_of(spark, d))


@query(f"WITH {CALLS} SELECT DISTINCT caller_id, callee_id, line_number FROM calls")
def edge_dedup(spark, d):
    return graph.dedup_calls(calls_of(spark, d))


@query(f"WITH {CALLS} SELECT callee_id, CAST(count(*) AS BIGINT) AS n FROM calls WHERE caller_id IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND callee_id IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY callee_id")
def edge_integrity(spark, d):
    known = functions_of(spark, d).where("line_start <= 25")
    return graph.with_endpoints(calls_of(spark, d), known).groupBy("callee_id").agg(F.count(F.lit(1)).alias("n"))


def bfs_sql(src, dst, depth):
    return f"""WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT {src} AS a, {dst} AS b FROM calls),
w AS (SELECT min(p_partkey) AS id, 0 AS depth FROM part UNION SELECT e.b, depth + 1 FROM w JOIN e ON e.a = w.id WHERE depth < {depth})
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id"""


def start_of(spark, d):
    return functions_of(spark, d).agg(F.min("id").alias("id"))


@query(bfs_sql("caller_id", "callee_id", 3))
def bfs_callees_d3(spark, d):
    return graph.bfs(calls_of(spark, d), start_of(spark, d), 3)


@query(bfs_sql("callee_id", "caller_id", 3))
def bfs_callers_d3(spark, d):
    return graph.bfs(calls_of(spark, d), start_of(spark, d), 3, "callers")


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls),
w AS (SELECT [min(p_partkey)] AS path FROM part UNION ALL SELECT list_append(path, e.b) FROM w JOIN e ON e.a = path[-1] WHERE len(path) <= 2 AND NOT list_contains(path, e.b))
SELECT array_to_string(path, '>') AS path, len(path) = 3 AS deep FROM w
WHERE len(path) = 3 OR NOT EXISTS (SELECT 1 FROM e WHERE e.a = path[-1] AND NOT list_contains(path, e.b))""")
def call_chains_d2(spark, d):
    found = graph.chains(calls_of(spark, d), start_of(spark, d), 2)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") == 3).alias("deep"))


@query(f"""WITH {CALLS}, g AS (SELECT caller_id AS id, 0 AS i, 1 AS o FROM calls UNION ALL SELECT callee_id, 1, 0 FROM calls)
SELECT p_partkey AS id, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_degree, CAST(coalesce(sum(i + o), 0) AS BIGINT) AS degree
FROM part LEFT JOIN g ON id = p_partkey GROUP BY p_partkey ORDER BY degree DESC, 1 LIMIT 25""")
def degree_top(spark, d):
    return graph.most_complex(calls_of(spark, d), functions_of(spark, d), 25).select("id", "in_degree", "out_degree", "degree")


LATE = "SELECT * FROM lineitem WHERE l_returnflag = 'R'"


@query(f"WITH {CALLS.replace('FROM lineitem', "FROM lineitem WHERE l_returnflag = 'R'")} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT callee_id FROM calls)")
def leaf_functions(spark, d):
    return graph.without_callers(returned_calls(spark, d), functions_of(spark, d)).select("id")


@query(f"WITH {CALLS.replace('FROM lineitem', "FROM lineitem WHERE l_returnflag = 'R'")} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT caller_id FROM calls)")
def root_functions(spark, d):
    return graph.without_callees(returned_calls(spark, d), functions_of(spark, d)).select("id")


def returned_calls(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("caller_id"), F.lead("l_partkey").over(w).alias("callee_id"))
    return lines.where("callee_id is not null").select("caller_id", "callee_id", F.col("l_orderkey").alias("line_number"))


@query(f"WITH {CALLS} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT callee_id FROM calls)")
def leaf_functions_all_calls(spark, d):
    return graph.without_callers(calls_of(spark, d), functions_of(spark, d)).select("id")


@query(f"WITH {CALLS} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT caller_id FROM calls)")
def root_functions_all_calls(spark, d):
    return graph.without_callees(calls_of(spark, d), functions_of(spark, d)).select("id")


@query("SELECT p_type AS language, CAST(count(*) AS BIGINT) AS n_functions FROM part GROUP BY p_type")
def lang_distribution(spark, d):
    return graph.language_distribution(functions_of(spark, d))


@query("SELECT regexp_replace(url, '^.*/', '') AS file_name, CAST(count(*) AS BIGINT) AS n_functions FROM pages GROUP BY 1")
def file_distribution(spark, d):
    return graph.file_distribution(table(spark, d, "pages").select(F.col("url").alias("file_path")))


@query(f"WITH {CALLS} SELECT (SELECT count(*) FROM part) AS total_functions, (SELECT count(DISTINCT p_brand) FROM part) AS total_files, (SELECT count(*) FROM calls) AS total_calls, (SELECT count(*) FROM calls) AS resolved_calls, 0::BIGINT AS unresolved_calls")
def graph_stats(spark, d):
    return graph.stats(calls_of(spark, d), functions_of(spark, d)).drop("languages")


LAYER_NAMES = "copsnr"


def layers(spark, d):
    """Customers own orders, orders hold parts, parts come from suppliers, suppliers sit in nations, nations in regions.

    An id is the key times 8 plus the place of its layer in LAYER_NAMES: half the bytes of its name."""
    o, l, s, n, c = (table(spark, d, t) for t in ("orders", "lineitem", "supplier", "nation", "customer"))
    k = lambda p, col: col.cast("long") * 8 + LAYER_NAMES.index(p)
    pairs = [
        (o, k("c", F.col("o_custkey")), k("o", F.col("o_orderkey"))),
        (l, k("o", F.col("l_orderkey")), k("p", F.col("l_partkey"))),
        (l, k("p", F.col("l_partkey")), k("s", F.col("l_suppkey"))),
        (s, k("s", F.col("s_suppkey")), k("n", F.col("s_nationkey"))),
        (c, k("c", F.col("c_custkey")), k("n", F.col("c_nationkey"))),
        (n, k("n", F.col("n_nationkey")), k("r", F.col("n_regionkey"))),
    ]
    out = None
    for df, a, b in pairs:
        e = df.select(a.alias("caller_id"), b.alias("callee_id"))
        out = e if out is None else out.unionAll(e)
    return out.withColumn("line_number", F.lit(0))


LAYERS = """e AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
  UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


@query(f"""WITH RECURSIVE {LAYERS}, w AS (SELECT DISTINCT a AS id, 0 AS level FROM e WHERE a NOT IN (SELECT b FROM e)
  UNION SELECT e.b, level + 1 FROM w JOIN e ON e.a = w.id)
SELECT id, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY id""")
def topo_levels(spark, d):
    names = F.array(*[F.lit(x) for x in LAYER_NAMES])
    name = F.concat(F.get(names, F.pmod(F.col("id"), F.lit(8)).cast("int")), F.shiftright("id", 3).cast("string"))
    return graph.topological_levels(layers(spark, d)).select(name.alias("id"), "level")


def successors(spark, d):
    """Every part calls the part that follows it most often (ties: the smallest)."""
    n = calls_of(spark, d).groupBy("caller_id", "callee_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("caller_id").agg(F.min_by("callee_id", F.struct(-F.col("n"), "callee_id")).alias("callee_id")).withColumn("line_number", F.lit(0))


SUCCESSORS = f"""{CALLS}, e AS (SELECT caller_id AS a, callee_id AS b FROM (
  SELECT caller_id, callee_id, row_number() OVER (PARTITION BY caller_id ORDER BY count(*) DESC, callee_id) AS k FROM calls GROUP BY 1, 2) WHERE k = 1),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)"""


@query(f"""WITH RECURSIVE {SUCCESSORS}, m AS (SELECT x.a, min(x.b) AS low FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT p_partkey AS id, CASE WHEN low IS NULL OR low > p_partkey THEN p_partkey ELSE low END AS component FROM part LEFT JOIN m ON a = p_partkey""")
def strong_components(spark, d):
    return graph.strong_components(successors(spark, d), functions_of(spark, d))


@query(f"WITH RECURSIVE {SUCCESSORS} SELECT bool_or(a = b) AS has_cycles FROM r")
def has_cycle(spark, d):
    return spark.createDataFrame([(graph.strong_has_cycle(successors(spark, d)),)], "has_cycles boolean")


@query()
def strong_components_all_calls(spark, d):
    """Over every call; no SQL, as the closure of a graph this dense is too slow. Tests use brute force."""
    return graph.strong_components(calls_of(spark, d), functions_of(spark, d))


@query()
def has_cycle_all_calls(spark, d):
    return spark.createDataFrame([(graph.strong_has_cycle(calls_of(spark, d)),)], "has_cycles boolean")


@query(f"""WITH RECURSIVE {SUCCESSORS}, c AS (SELECT a, [a] AS path, b AS last FROM e UNION ALL SELECT c.a, list_append(path, last), e.b FROM c JOIN e ON e.a = last WHERE last > c.a AND NOT list_contains(path, last) AND len(path) < 6)
SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS length FROM c WHERE last = a""")
def cycle_paths(spark, d):
    return graph.cycles(successors(spark, d), 6).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


@query("SELECT p_partkey AS id, p_name AS name, 'function' AS kind FROM part UNION ALL SELECT s_suppkey, s_name, 'class' FROM supplier")
def entity_union(spark, d):
    return graph.entities(functions_of(spark, d).select("id", "name"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).select("id", "name", "kind")


# Resolution


@query("""WITH f AS (SELECT event_id AS fn_id, user_id, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + 86400 + (event_id % 7) * 3600 AS b FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
c AS (SELECT event_id AS call_id, user_id, epoch(ts)::BIGINT AS line FROM events)
SELECT call_id, fn_id FROM c LEFT JOIN f ON c.user_id = f.user_id AND line BETWEEN a AND b
QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY a DESC, b, fn_id) = 1""")
def enclosing_interval(spark, d):
    # seconds are rounded, halves to even, as the SQL's cast of a DOUBLE does
    line = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", line.alias("line"))
    kind = e.agg(F.min("event_type")).first()[0]
    f = e.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("file_path"), F.col("line").alias("line_start"), (F.col("line") + 86400 + F.col("event_id") % 7 * 3600).alias("line_end"))
    c = e.select(F.col("event_id").alias("call_id"), F.col("user_id").cast("string").alias("file_path"), "line")
    return resolve.enclosing(c, f, block=1 << 17).select("call_id", "fn_id")


def name_sites(spark, d):
    """Every supplier's nation calls names: parts by brand of the same number, some of them unknown."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.select(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 60).cast("string")).alias("file_path"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("ns::"), "p_name")).when(F.col("l_linenumber") == 2, F.concat(F.col("p_name"), F.lit("?"))).otherwise(F.col("p_name")).alias("callee_name"), "l_orderkey")


RESOLVE = """f AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_size AS line FROM part),
lo AS (SELECT file, name, arg_min(id, (line, id)) AS id FROM f GROUP BY 1, 2), gl AS (SELECT name, arg_min(id, (file, line, id)) AS id FROM f GROUP BY 1),
c AS (SELECT 'Brand#' || (l_suppkey % 60) AS file, CASE l_linenumber WHEN 1 THEN 'ns::' || p_name WHEN 2 THEN p_name || '?' ELSE p_name END AS callee FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT c.*, lo.id AS lid, g1.id AS gid, g2.id AS bid FROM c LEFT JOIN lo ON lo.file = c.file AND lo.name = callee LEFT JOIN gl g1 ON g1.name = callee LEFT JOIN gl g2 ON callee LIKE '%::%' AND g2.name = regexp_replace(callee, '^.*::', ''))"""


@query(f"WITH {RESOLVE} SELECT coalesce(lid, gid, bid) AS callee_id, CASE WHEN lid IS NOT NULL THEN 'local' WHEN gid IS NOT NULL THEN 'global' WHEN bid IS NOT NULL THEN 'qualified' ELSE 'unresolved' END AS scope, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2")
def callee_local_then_global(spark, d):
    return resolve.resolve_names(name_sites(spark, d), functions_of(spark, d)).groupBy("callee_id", "scope").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESOLVE} SELECT callee AS name, CAST(count(*) AS BIGINT) AS n FROM r WHERE coalesce(lid, gid, bid) IS NULL GROUP BY 1")
def unresolved_calls(spark, d):
    out = resolve.resolve_names(name_sites(spark, d), functions_of(spark, d)).where("not is_resolved")
    return out.groupBy(F.col("callee_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


# Detector


IDENT = "regexp_extract_all(coalesce(html, ''), '[a-zA-Z_$][a-zA-Z0-9_$]*')"
WIDTH = "octet_length(encode(coalesce(html, ''))) / CAST(len(list_filter(string_split(coalesce(html, ''), chr(10)), lambda x: trim(x, '" + X.WHITE + "') <> '')) AS DOUBLE)"
MARKS = " OR ".join(f"contains(coalesce(html, ''), '{f}')" for f in D.FINGERPRINTS)


@query(f"""SELECT page_id, CASE WHEN trim(coalesce(html, ''), '{X.WHITE}') = '' THEN 'Empty' WHEN {MARKS} THEN 'CompiledCode' WHEN {WIDTH} > 250 THEN 'CompiledCode'
WHEN len({IDENT}) < 50 THEN 'SourceCode' WHEN len(list_filter({IDENT}, lambda i: length(i) <= 2)) / CAST(len({IDENT}) AS DOUBLE) > 0.55 THEN 'CompiledCode' ELSE 'SourceCode' END AS code_type FROM pages""")
def detector_class(spark, d):
    return D.detect(table(spark, d, "pages"), "html").select("page_id", "code_type")


@query(f"SELECT page_id, round({WIDTH}, 6) AS width, CAST(len({IDENT}) AS INTEGER) AS n_identifiers, round(len(list_filter({IDENT}, lambda i: length(i) <= 2)) / CAST(len({IDENT}) AS DOUBLE), 6) AS short_share FROM pages")
def detector_metrics(spark, d):
    c = F.coalesce(F.col("html"), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.round(D.bytes_per_line(c), 6).alias("width"), F.size(D.identifiers(c)).alias("n_identifiers"), F.round(D.short_share(c), 6).alias("short_share"))


# Incremental


def snapshots(spark, d):
    """The corpus before and after an edit: source src1 is new, src2 is gone, and texts of src3 have one more line."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "source")
    old = docs.where("source <> 'src1'")
    new = docs.where("source <> 'src2'").withColumn("content", F.when(F.col("source") == "src3", F.concat("content", F.lit("\nedited"))).otherwise(F.col("content")))
    return old, new


SNAPSHOTS = """o AS (SELECT doc_id::VARCHAR AS path, text, source, md5(coalesce(text, '')) AS h FROM documents WHERE source <> 'src1'),
n AS (SELECT path, text, source, md5(coalesce(text, '')) AS h FROM (SELECT doc_id::VARCHAR AS path, CASE WHEN source = 'src3' THEN text || chr(10) || 'edited' ELSE text END AS text, source FROM documents WHERE source <> 'src2')),
st AS (SELECT path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (path))"""


@query(f"WITH {SNAPSHOTS} SELECT path, status FROM st")
def change_classify(spark, d):
    old, new = snapshots(spark, d)
    return incremental.classify(incremental.hashes(old), incremental.hashes(new))


@query(f"WITH {SNAPSHOTS} SELECT path, md5(coalesce(text, '')) AS md5 FROM n")
def incremental_replace(spark, d):
    old, new = snapshots(spark, d)
    status = incremental.classify(incremental.hashes(old), incremental.hashes(new))
    fresh = new.join(status.where("status in ('new', 'changed')"), "path", "left_semi")
    out = incremental.replace_files(old, fresh, status.where("status <> 'unchanged'"), "path")
    return incremental.hashes(out)


@query(f"WITH {SNAPSHOTS} SELECT source, CAST(count(*) AS BIGINT) AS n FROM o WHERE path NOT IN (SELECT path FROM st WHERE status = 'deleted') GROUP BY source")
def deletion_propagate(spark, d):
    old, new = snapshots(spark, d)
    gone = incremental.classify(incremental.hashes(old), incremental.hashes(new)).where("status = 'deleted'")
    return incremental.propagate_deletes({"t": old}, gone, "path")["t"].groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT DISTINCT md5('m1' || coalesce(text, '')) AS h FROM documents WHERE source <> 'src4')
SELECT DISTINCT md5('m1' || coalesce(text, '')) AS hash FROM documents WHERE md5('m1' || coalesce(text, '')) NOT IN (SELECT h FROM c)""")
def cache_miss(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.where("source <> 'src4'").select(vectors.cache_key("m1", F.col("text")).alias("hash"))
    return vectors.cache_misses(docs, cache, "m1", "text").select("hash")


# Knowledge


@query("""SELECT conv_id, turn, substr(text, 1, 30) AS title, substr(text, 1, 500) AS content FROM conversations""")
def sanitize(spark, d):
    from ..operators import knowledge

    return knowledge.sanitise(table(spark, d, "conversations").withColumn("title", F.col("text")).withColumn("content", F.col("text"))).select("conv_id", "turn", "title", "content")


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant' AND list_contains(string_split(lower(text), ' '), 'the') ORDER BY conv_id, turn, md5(text) LIMIT 50")
def knowledge_list(spark, d):
    t = table(spark, d, "conversations").withColumn("tags", F.split(F.lower("text"), " "))
    return t.where((F.col("role") == "assistant") & F.array_contains("tags", "the")).orderBy("conv_id", "turn", F.md5(F.col("text").cast("binary"))).limit(50).select("conv_id", "turn", "role")


# Streaming, batch form


DEBOUNCE = """g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"""


@query(f"WITH {DEBOUNCE} SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_ts, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT event_type) AS BIGINT) AS n_paths FROM s GROUP BY user_id, k")
def debounce_sessions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    out = watch.debounce(e, "1 hour")
    return out.select(F.col("project").alias("user_id"), F.unix_timestamp("first_ts").alias("first_ts"), "n_events", F.size("paths").cast("long").alias("n_paths"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY event_type")
def event_filter(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"))
    return watch.of_kinds(e, ("purchase", "click", "view")).groupBy(F.col("kind").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


# Evaluation and export


@query(f"""WITH {BM25}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc),
j AS (SELECT source, min(rank) AS rank FROM r JOIN (SELECT doc_id, source FROM documents) USING (doc_id) JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
SELECT CAST(count(*) AS BIGINT) AS n_queries, round(avg(1.0 / rank), 6) AS mrr FROM j""")
def mrr(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    fields = {"content": "text"}
    s = bm25.scores(bm25.postings(docs, "doc_id", fields, "default"), bm25.field_stats(docs, "doc_id", fields, "default"), ["the", "que", "der", "with"])
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    hits = evaluate.rank_all(s.select("id", F.round("score", 9).alias("score")))
    relevant = docs.join(good, "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("id"))
    return evaluate.mean_reciprocal_rank(hits, relevant).withColumn("mrr", F.round("mrr", 6))


@query(f"WITH {BM25} SELECT round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, round(avg(score), 6) AS mean, round(max(score), 6) AS top FROM sc")
def score_percentiles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = bm25.scores(bm25.postings(docs, "doc_id", {"content": "text"}, "default"), bm25.field_stats(docs, "doc_id", {"content": "text"}, "default"), ["the", "que", "der", "with"])
    out = evaluate.score_percentiles(s)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"WITH {BM25}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS k FROM sc) SELECT round(count(*) FILTER (k <= 10) / 10.0, 6) AS overlap FROM r")
def stability_overlap(spark, d):
    few, more = bm25_docs(spark, d, 10), bm25_docs(spark, d, 50)
    return evaluate.overlap(few, more).withColumn("overlap", F.round("overlap", 6))


@query(f"WITH {CALLS} SELECT DISTINCT '  \"' || caller_id || '\" -> \"' || callee_id || '\";' AS line FROM calls")
def dot_lines(spark, d):
    return export.dot_edges(calls_of(spark, d).withColumn("is_resolved", F.lit(True))).distinct()


@query("SELECT p_partkey AS id, '{\"id\":' || p_partkey || ',\"name\":\"' || p_name || '\",\"file\":\"' || p_brand || '\"}' AS json FROM part")
def json_rows(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))
    return export.to_json_rows(p).select(F.get_json_object("json", "$.id").cast("long").alias("id"), "json")


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(text)) AS k FROM conversations)
SELECT conv_id, string_agg(role || ' ' || length(text), chr(10) || chr(10) ORDER BY turn, md5(text)) AS skeleton FROM c WHERE turn = 0 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY conv_id""")
def skeleton_toplevel(spark, d):
    from ..operators import skeleton

    c = table(spark, d, "conversations").withColumn("h", F.md5(F.col("text").cast("binary")))
    symbols = c.select(F.col("conv_id").alias("file_path"), F.concat_ws(":", "conv_id", "turn", "h").alias("symbol_id"), F.when(F.col("turn") > 0, F.concat("conv_id", F.lit(":0"))).alias("parent_id"), F.col("turn").alias("start_row"), F.col("h"), F.concat_ws(" ", "role", F.length("text").cast("string")).alias("part"))
    roots = c.where("turn = 0").select(F.concat("conv_id", F.lit(":0")).alias("symbol_id"))
    return skeleton.file_text(symbols, roots).select(F.col("file_path").alias("conv_id"), "skeleton")


@query("""SELECT c_mktsegment AS kind, CAST(count(*) AS BIGINT) AS n, round(min(c_acctbal), 6) AS low, round(max(c_acctbal), 6) AS high, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS middle FROM customer GROUP BY 1""")
def summary_stats(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("c_acctbal"), 6).alias("low"), F.round(F.max("c_acctbal"), 6).alias("high"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.percentile("c_acctbal", F.lit(0.5)), 6).alias("middle")
    )
