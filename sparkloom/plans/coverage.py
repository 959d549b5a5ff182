"""Queries on operators that the shared tables do not reach by themselves: extraction, skeletons and lookups over the
fixture sources, whose expected rows are written out in the SQL, and maintenance, ranking and files over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import text as X
from ..operators import bm25, export, extract, fusion, graph, incremental, knowledge, resolve, skeleton, vectors
from ..sources import files as sources
from ..streaming import watch
from . import api, fixtures
from .catalogue import BM25, CALLS, CODE_TOKENS, DISTANCE, RESOLVE, SYMBOL, bm25_docs, calls_of, functions_of, name_sites, probe, query, symbol_of, table, vectors_of

WHITE_SQL = "'" + X.WHITE + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of the rows written out."""
    say = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) AS t({columns})"


# Extraction


def symbols(spark) -> DataFrame:
    return extract.extract(fixtures.files_of(spark))


def symbol_rows(spark, path: str) -> DataFrame:
    s = symbols(spark).where(F.col("file_path") == path)
    names = s.select(F.col("symbol_id").alias("parent_id"), F.col("name").alias("parent"))
    out = s.where("kind not in ('comment', 'variable')").join(names, "parent_id", "left")
    return out.select("kind", "name", "start_row", "end_row", "parent")


SYMBOL_COLUMNS = "kind, name, start_row, end_row, parent"


@query(values(SYMBOL_COLUMNS, [("import", "json", 0, 0, None), ("import", "fmt", 1, 1, None), ("struct", "Account", 3, 8, None), ("field", "limit", 5, 5, "Account"), ("function", "pay", 7, 8, "Account"), ("call", "f", 8, 8, "pay"), ("function", "test_pay", 10, 12, None), ("call", "Account", 11, 11, "test_pay"), ("call", "pay", 12, 12, "test_pay"), ("call", "test_pay", 14, 14, None)]))
def symbols_python(spark, d):
    return symbol_rows(spark, "app/bank.py")


@query(values(SYMBOL_COLUMNS, [("import", "HashMap", 0, 0, None), ("struct", "Stack", 3, 5, None), ("field", "items", 4, 4, "Stack"), ("struct", "Stack", 7, 12, None), ("function", "push", 8, 11, "Stack"), ("call", "check", 9, 9, "push"), ("call", "push", 10, 10, "push"), ("function", "check", 14, 16, None)]))
def symbols_rust(spark, d):
    return symbol_rows(spark, "src/stack.rs")


@query(values(SYMBOL_COLUMNS, [("import", "part.js", 0, 0, None), ("struct", "Cart", 1, 5, None), ("function", "add", 2, 4, "Cart"), ("call", "note", 3, 3, "add"), ("function", "total", 6, 8, None), ("call", "sum", 7, 7, "total"), ("function", "main", 9, 11, None), ("call", "total", 10, 10, "main")]))
def symbols_javascript(spark, d):
    return symbol_rows(spark, "web/cart.js")


@query(values(SYMBOL_COLUMNS, [("struct", "Shape", 0, 2, None), ("field", "name", 1, 1, "Shape"), ("struct", "Kind", 3, 3, None), ("field", "Round", 3, 3, "Kind"), ("field", "Flat", 3, 3, "Kind"), ("struct", "Disc", 4, 9, None), ("field", "name", 5, 5, "Disc"), ("function", "area", 6, 8, "Disc"), ("call", "square", 7, 7, "area")]))
def symbols_typescript(spark, d):
    return symbol_rows(spark, "web/shape.ts")


@query(values(SYMBOL_COLUMNS, [("import", "fmt", 2, 4, None), ("struct", "Pair", 6, 9, None), ("field", "A", 7, 7, "Pair"), ("field", "B", 8, 8, "Pair"), ("function", "Sum", 11, 13, None), ("call", "add", 12, 12, "Sum"), ("function", "add", 15, 17, None)]))
def symbols_go(spark, d):
    return symbol_rows(spark, "srv/main.go")


@query(values(SYMBOL_COLUMNS, [("import", "List", 1, 1, None), ("struct", "Box", 2, 10, None), ("field", "size", 3, 3, "Box"), ("function", "Box", 4, 6, "Box"), ("function", "twice", 7, 9, "Box"), ("call", "scale", 8, 8, "twice")]))
def symbols_java(spark, d):
    return symbol_rows(spark, "j/Box.java")


@query(values(SYMBOL_COLUMNS, [("import", "vector", 0, 0, None), ("struct", "Ring", 2, 8, None), ("field", "width", 4, 4, "Ring"), ("function", "area", 5, 7, "Ring"), ("call", "mul", 6, 6, "area"), ("function", "main", 10, 12, None)]))
def symbols_cpp(spark, d):
    return symbol_rows(spark, "c/ring.cpp")


@query(values("file_path, name, is_error", [("web/broken.js", "fine", False), ("web/broken.js", "lost", True), ("app/broken.py", "one", True), ("app/broken.py", "two", True)]))
def calls_in_broken_files(spark, d):
    return symbols(spark).where("kind = 'call' and file_path like '%broken%'").select("file_path", "name", "is_error")


@query(values("file_path, name, line_start, line_end, language, signature", [
    ("app/bank.py", "pay", 8, 9, "python", "pay()"), ("app/bank.py", "test_pay", 11, 13, "python", "test_pay()"), ("c/ring.cpp", "area", 6, 8, "cpp", "area()"), ("c/ring.cpp", "main", 11, 13, "cpp", "main()"),
    ("j/Box.java", "Box", 5, 7, "java", "Box()"), ("j/Box.java", "twice", 8, 10, "java", "twice()"), ("src/stack.rs", "push", 9, 12, "rust", "push()"), ("src/stack.rs", "check", 15, 17, "rust", "check()"),
    ("srv/main.go", "Sum", 12, 14, "go", "Sum()"), ("srv/main.go", "add", 16, 18, "go", "add()"), ("web/cart.js", "add", 3, 5, "javascript", "add()"), ("web/cart.js", "total", 7, 9, "javascript", "total()"),
    ("web/cart.js", "main", 10, 12, "javascript", "main()"), ("web/shape.ts", "area", 7, 9, "typescript", "area()")]))
def function_rows(spark, d):
    f = extract.functions_of(symbols(spark), fixtures.files_of(spark)).where("file_path not like '%broken%'")
    return f.select("file_path", "name", "line_start", "line_end", "language", "signature")


@query(values("file_path, name, class_type, parent_class, n_functions, variables", [
    ("app/bank.py", "Account", "Class", "Base", 1, "limit"), ("c/ring.cpp", "Ring", "Class", "Shape", 1, "width"), ("j/Box.java", "Box", "Class", None, 2, "size"), ("src/stack.rs", "Stack", "Struct", None, 0, "items"),
    ("src/stack.rs", "Stack", "Struct", None, 1, ""), ("srv/main.go", "Pair", "Struct", None, 0, "A,B"), ("web/cart.js", "Cart", "Class", "Base", 1, ""), ("web/shape.ts", "Shape", "Interface", None, 0, "name"),
    ("web/shape.ts", "Kind", "Enum", None, 0, "Flat,Round"), ("web/shape.ts", "Disc", "Class", "Shape", 1, "name")]))
def class_rows(spark, d):
    c = extract.classes_of(symbols(spark), fixtures.files_of(spark))
    return c.select("file_path", "name", "class_type", "parent_class", F.size("member_functions").alias("n_functions"), F.array_join("member_variables", ",").alias("variables"))


@query(values("path, namespace", [("src/stack.rs", "crate"), ("app/bank.py", "global"), ("web/cart.js", "global"), ("web/shape.ts", "global"), ("srv/main.go", "srv"), ("j/Box.java", "j"), ("c/ring.cpp", "geo"), ("web/broken.js", "global"), ("app/broken.py", "global")]))
def namespaces(spark, d):
    return fixtures.files_of(spark).select("path", X.namespace(F.col("content"), F.col("language")).alias("namespace"))


@query(values("name, content", [("pay", "    def pay(self, n):\n        return f(n)"), ("test_pay", "def test_pay():\n    a = Account()\n    a.pay(3)")]))
def snippet_text(spark, d):
    return symbols(spark).where("file_path = 'app/bank.py' and kind = 'function'").select("name", "content")


def text_symbols(spark, d) -> DataFrame:
    """Documents as symbols: functions, structs and comments by turns."""
    kind = F.element_at(F.array(F.lit("function"), F.lit("struct"), F.lit("comment")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("source").alias("file_path"), F.col("lang").alias("language"), kind.alias("kind"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"), F.lit(0).alias("start_row"), F.lit(9).alias("end_row"))


@query(f"SELECT concat_ws('#', source, '1', doc_id) AS snippet_id, CASE doc_id % 3 WHEN 0 THEN 'FunctionDeclaration' ELSE 'StructDeclaration' END AS symbol_type FROM documents WHERE doc_id % 3 < 2 AND length(trim(text, {WHITE_SQL})) >= 16")
def chunk_rows(spark, d):
    return extract.chunks_of(text_symbols(spark, d)).select("snippet_id", "symbol_type")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(left(text, 64), '')) AS ch, generate_subscripts(string_split(left(text, 64), ''), 1) AS i FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, i, ch, sum(octet_length(encode(ch))) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM c)
SELECT doc_id, coalesce(string_agg(ch, '' ORDER BY i) FILTER (n <= 64), '') AS head FROM s GROUP BY doc_id""")
def truncated_bytes(spark, d):
    docs = table(spark, d, "documents").where("length(text) > 0").dropDuplicates(["doc_id"])
    return docs.select("doc_id", X.truncate_bytes(F.col("text"), 64).alias("head"))


# Skeletons


SKELETONS = [
    ("app/bank.py", 3, "class Account(Base)\n  limit = 10\n  def pay(self, n)\n    ...\n"), ("app/bank.py", 10, "def test_pay()\n  ...\n"),
    ("c/ring.cpp", 2, "class Ring : public Shape {\n  int width;\n  int area() { ... }\n}"), ("c/ring.cpp", 10, "int main() { ... }"),
    ("j/Box.java", 2, "public class Box {\n  private int size;\n  public Box(int size) { ... }\n  int twice() { ... }\n}"),
    ("src/stack.rs", 3, "pub struct Stack {\n  items: Vec<i64>,\n}"), ("src/stack.rs", 7, "impl Stack {\n  pub fn push(&mut self, x: i64) { ... }\n}"), ("src/stack.rs", 14, "fn check(x: i64) -> bool { ... }"),
    ("srv/main.go", 6, "type Pair struct {\n  A int\n  B int\n}"), ("srv/main.go", 11, "func (p Pair) Sum() int { ... }"), ("srv/main.go", 15, "func add(a int, b int) int { ... }"),
    ("web/cart.js", 1, "class Cart extends Base {\n  add(item) { ... }\n}"), ("web/cart.js", 6, "const total = (xs) => { ... }"), ("web/cart.js", 9, "function main() { ... }"),
    ("web/shape.ts", 0, "interface Shape {\n  name: string;\n}"), ("web/shape.ts", 3, "enum Kind {\n  Round;\n  Flat;\n}"), ("web/shape.ts", 4, "class Disc implements Shape {\n  name: string;\n  area(): number { ... }\n}"),
]


def sound(spark) -> DataFrame:
    return symbols(spark).where("file_path not like '%broken%'")


@query(values("file_path, start_row, skeleton", SKELETONS))
def skeleton_rows(spark, d):
    return skeleton.skeletons(sound(spark)).select("file_path", "start_row", "skeleton")


@query(f"SELECT file_path, string_agg(skeleton, chr(10) || chr(10) ORDER BY start_row) AS skeleton_text FROM ({values('file_path, start_row, skeleton', SKELETONS)}) GROUP BY file_path")
def skeleton_files(spark, d):
    return skeleton.file_skeletons(sound(spark)).select("file_path", "skeleton_text")


@query(values("json", [('{"success":true,"data":{"skeletons":[{"filepath":"app/none.py","language":"unknown","skeleton_text":"error: no symbols found in app/none.py"},{"filepath":"srv/main.go","language":"go","skeleton_text":"type Pair struct {\\n  A int\\n  B int\\n}\\n\\nfunc (p Pair) Sum() int { ... }\\n\\nfunc add(a int, b int) int { ... }"}]}}',)]))
def skeleton_batch(spark, d):
    return skeleton.batch_json(sound(spark), spark.createDataFrame([("srv/main.go",), ("app/none.py",)], "path string"))


@query(values("file_path, top_row, bottom_row, line", [
    ("app/bank.py", 3, 4, 'class Account(Base)\n    """Money of one owner."""\n    ...'), ("app/bank.py", 7, 8, "def pay(self, n):\n    return f(n)"), ("app/bank.py", 10, 12, "def test_pay():\n    a = Account()\n    a.pay(3)"),
    ("src/stack.rs", 2, 3, "/// A stack\npub struct Stack { ... }"), ("src/stack.rs", 7, 7, "impl Stack { ... }"), ("src/stack.rs", 8, 11, "pub fn push(&mut self, x: i64) {\n    check(x);\n    self.items.push(x);\n}"), ("src/stack.rs", 14, 16, "fn check(x: i64) -> bool {\n    x > 0\n}")]))
def declaration_rows(spark, d):
    s = symbols(spark).where("file_path in ('app/bank.py', 'src/stack.rs')")
    return skeleton.declarations(s).select("file_path", "top_row", "bottom_row", "line")


# Resolution


@query(values("caller_file, line_number, caller_name, callee_name, callee_file, is_resolved", [
    ("app/bank.py", 12, "test_pay", "Account", None, False), ("app/bank.py", 13, "test_pay", "pay", "app/bank.py", True), ("c/ring.cpp", 7, "area", "mul", None, False), ("j/Box.java", 9, "twice", "scale", None, False),
    ("src/stack.rs", 10, "push", "check", "src/stack.rs", True), ("src/stack.rs", 11, "push", "push", "src/stack.rs", True), ("srv/main.go", 13, "Sum", "add", "srv/main.go", True),
    ("web/cart.js", 4, "add", "note", None, False), ("web/cart.js", 8, "total", "sum", None, False), ("web/cart.js", 11, "main", "total", "web/cart.js", True), ("web/shape.ts", 8, "area", "square", None, False),
    ("app/bank.py", 9, "pay", "f", None, False)]))
def calls_inside_functions(spark, d):
    """The call of test_pay in no function is dropped."""
    s, files = sound(spark), fixtures.files_of(spark)
    out = resolve.build_calls(extract.call_sites(s), extract.functions_of(s, files))
    return out.select("caller_file", "line_number", "caller_name", "callee_name", "callee_file", "is_resolved")


@query(f"WITH {RESOLVE} SELECT DISTINCT callee AS name, 'unresolved' AS namespace, 'unknown' AS language FROM r WHERE coalesce(lid, gid, bid) IS NULL")
def unresolved_placeholders(spark, d):
    return resolve.placeholders(resolve.resolve_names(name_sites(spark, d), functions_of(spark, d))).select("name", "namespace", "language")


@query("""WITH f AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS file, CASE s_suppkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'test_' || s_suppkey % 8 ELSE s_suppkey % 8 || '' END AS name FROM supplier)
SELECT a.id AS caller_id, b.id AS callee_id FROM f a JOIN f b ON a.file = b.file AND a.id <> b.id WHERE a.name = 'main' OR (a.name LIKE '%test%' AND contains(a.name, b.name))""")
def guessed_calls(spark, d):
    name = F.when(F.col("s_suppkey") % 4 == 0, "main").when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("test_"), F.col("s_suppkey") % 8)).otherwise((F.col("s_suppkey") % 8).cast("string"))
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("file_path"), name.alias("name"), F.lit(1).alias("line_start"))
    return resolve.guessed_calls(f).select("caller_id", "callee_id")


# Graph


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def functions_of_file(spark, d):
    f = functions_of(spark, d)
    return graph.find_by_file(f, f.agg(F.min("file_path")).first()[0]).select("id", "name")


@query("SELECT p_brand AS class_name, p_partkey AS id, p_name AS name FROM part WHERE p_size > 10")
def class_member_rows(spark, d):
    f = functions_of(spark, d)
    c = f.where("line_start > 10").groupBy("file_path").agg(F.collect_list("id").alias("member_functions")).select(F.col("file_path").alias("id"), F.col("file_path").alias("name"), "member_functions")
    return graph.class_members(c, f).select("class_name", "id", "name")


@query("SELECT p_type AS language, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def stats_languages(spark, d):
    return graph.stats(calls_of(spark, d), functions_of(spark, d)).select(F.explode("languages").alias("language", "n"))


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls), c AS (SELECT p_partkey AS id FROM part WHERE p_name = ({SYMBOL}) ORDER BY p_brand, p_size, p_partkey LIMIT 1),
w AS (SELECT id, 0 AS depth FROM c UNION SELECT e.b, depth + 1 FROM w JOIN e ON e.a = w.id WHERE depth < 1), k AS (SELECT DISTINCT id FROM w WHERE id NOT IN (SELECT id FROM c))
SELECT (SELECT p_name FROM part JOIN c ON p_partkey = id) AS centre, (SELECT count(*) FROM k) AS n_children, (SELECT string_agg(p_name, ',' ORDER BY id) FROM k JOIN part ON p_partkey = id) AS children""")
def call_tree_d1(spark, d):
    tree = graph.call_tree(calls_of(spark, d), functions_of(spark, d), symbol_of(spark, d), 1)
    kids = [k["name"] for k in tree["children"]]
    return spark.createDataFrame([(tree["name"], len(kids), ",".join(kids) or None)], "centre string, n_children long, children string")


@query("""SELECT 'Functions: ' || (SELECT count(*) FROM part) AS line UNION ALL SELECT 'Files: ' || (SELECT count(DISTINCT p_brand) FROM part) UNION ALL SELECT '  ' || p_type || ': ' || count(*) FROM part GROUP BY p_type""")
def report_lines(spark, d):
    text = graph.report(calls_of(spark, d), functions_of(spark, d), 0)
    keep = [(x,) for x in text.split("\n") if x.startswith(("Functions:", "Files:", "  "))]
    return spark.createDataFrame(keep, "line string")


# Index entry points, over the fixture index


@query(values("total_functions, total_files, indexed", [(18, 9, True)]))
def index_status(spark, d):
    return api.status(fixtures.index_of(spark), "x").select("total_functions", "total_files", "indexed")


@query(values("new, changed, unchanged, deleted", [(9, 0, 0, 0), (1, 1, 7, 1)]))
def index_builds(spark, d):
    """A first build of all files, and one after an edit, a new file and a deleted one."""
    out, files = fixtures.folder(spark, "index-builds"), fixtures.SOURCES
    later = {k: v for k, v in files.items() if k != "c/ring.cpp"} | {"web/cart.js": files["web/cart.js"] + "// end\n", "web/new.js": "function fresh() {\n  return 1;\n}\n"}
    builds = [api.build_index(spark, sources.files_from_rows(spark, list(x.items())), out) for x in (files, later)]
    return spark.createDataFrame([(b.new, b.changed, b.unchanged, b.deleted) for b in builds], "new int, changed int, unchanged int, deleted int")


@query(values("name, kind, file_path", [("add", "function", "srv/main.go"), ("add", "function", "web/cart.js")]))
def index_entities(spark, d):
    return api.search_entities(fixtures.index_of(spark), "add").select("name", "kind", "file_path")


@query(values("name, class_type, file_path", [("Stack", "Struct", "src/stack.rs"), ("Stack", "Struct", "src/stack.rs")]))
def index_classes(spark, d):
    return fixtures.index_of(spark).classes.where("name = 'Stack' and file_path = 'src/stack.rs'").select("name", "class_type", "file_path")


@query(values("class_type, n", [("Class", 5), ("Enum", 1), ("Interface", 1), ("Struct", 3)]))
def index_repository_stats(spark, d):
    return api.repository_stats(fixtures.index_of(spark)).select(F.explode("classes").alias("class_type", "n")).select("class_type", F.col("n").cast("int").alias("n"))


@query(values("asked, success, answer", [("check", True, "fn check(x: i64) -> bool {\n    x > 0\n}"), ("add", False, "ambiguous; give one of: srv/main.go, web/cart.js"), ("add@main.go", True, "func add(a int, b int) int {\n\treturn a + b\n}"), ("none", False, "function none not found")]))
def index_snippets(spark, d):
    index, rows = fixtures.index_of(spark), []
    for asked in ("check", "add", "add@main.go", "none"):
        name, _, path = asked.partition("@")
        r = api.snippet(index, name, path or None)
        rows.append((asked, r["success"], r["data"]["code_snippet"] if r["success"] else r["error"]))
    return spark.createDataFrame(rows, "asked string, success boolean, answer string")


@query(values("name, code_snippet", [("main", "function main() {\n  total([1]);\n}")]))
def index_caller_snippets(spark, d):
    return api.neighbour_snippets(fixtures.index_of(spark), "total").select("name", "code_snippet")


@query("SELECT path, md5(content) AS md5 FROM (" + values("path, content", list(fixtures.SOURCES.items())) + ")")
def index_hashes(spark, d):
    return fixtures.index_of(spark).hashes.select("path", "md5")


@query(values("n_vectors, n_dims, n_cached", [(28, 64, 28)]))
def index_vectors(spark, d):
    """A vector of every chunk; the cache holds distinct texts."""
    index = fixtures.index_of(spark)
    n = index.vectors.agg(F.count(F.lit(1)).cast("int").alias("n_vectors"), F.max(F.size("vector")).alias("n_dims"))
    return n.withColumn("n_cached", F.lit(index.cache.count()).cast("int"))


@query(values("name, code_snippet", [("pay", "    def pay(self, n):\n        return f(n)"), ("test_pay", "def test_pay():\n    a = Account()\n    a.pay(3)"), ("good", "def good():\n    return one(1)")]))
def index_warmed(spark, d):
    """The first three functions by file and line."""
    return api.warm(fixtures.index_of(spark), 3).select("name", "code_snippet")


@query(values("query, symbol_name, file_path, source", [("return scale size twice", "twice", "j/Box.java", "Fused"), ("items push check", "push", "src/stack.rs", "Fused")]))
def index_search(spark, d):
    """The best hit of two queries, found by both channels."""
    index, rows = fixtures.index_of(spark), []
    for q in ("return scale size twice", "items push check"):
        r = api.search(index, q, 1).first()
        rows.append((q, r["symbol_name"], r["file_path"], r["source"]))
    return spark.createDataFrame(rows, "query string, symbol_name string, file_path string, source string")


@query(values("project, indexed", [("one", True), ("two", True)]))
def project_list(spark, d):
    home = fixtures.folder(spark, "projects")
    one = spark.createDataFrame([("a", "b")], "path string, md5 string")
    for name in ("one", "two", "gone"):
        incremental.Snapshots(spark, f"{home}/{name}").write({"hashes": one})
    api.drop_index(spark, f"{home}/gone")
    return api.projects(spark, home).select("project", (F.col("version").isNotNull() & (F.col("size_bytes") > 0)).alias("indexed"))


# Sources


PATHS = ["a.rs", "src/B.PY", "web/x.tsx", "web/y.jsx", "c/z.inl", "c/z.hh", "j/K.java", "g/m.go", "k/n.kt", "target/a.rs", "x/node_modules/b.js", ".git/c.py", "out/d.go", "x/.cache/e.py", "outer/f.py", "README.md", "Makefile", "a/b.tar.py3", "conf/app.toml", "dist/a.js", "doc/.hid/b.md", "build.rs", "p/q.swift"]


def paths(spark) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


PATHS_SQL = values("path", [(p,) for p in PATHS])
EXT = r"lower(regexp_extract(path, '[^/\\]\.([^./\\]+)$', 1))"


@query(f"WITH p AS ({PATHS_SQL}) SELECT path, {EXT} IN ('{"', '".join(sources.EXTENSIONS)}') AS supported, NOT regexp_matches('/' || path, '/(\\.[^/]*|target|node_modules|__pycache__|out)/') AS scanned FROM p")
def scan_filters(spark, d):
    return paths(spark).select("path", sources.supported(F.col("path")).alias("supported"), sources.scanned(F.col("path")).alias("scanned"))


@query(values("path, language, shown", [
    ("a.rs", "rust", "rust"), ("src/B.PY", "python", "python"), ("web/x.tsx", "typescript", "tsx"), ("web/y.jsx", "javascript", "jsx"), ("c/z.inl", "unknown", "unknown"), ("c/z.hh", "cpp", "unknown"), ("j/K.java", "java", "java"),
    ("g/m.go", "go", "go"), ("k/n.kt", "unknown", "kotlin"), ("target/a.rs", "rust", "rust"), ("x/node_modules/b.js", "javascript", "javascript"), (".git/c.py", "python", "python"), ("out/d.go", "go", "go"), ("x/.cache/e.py", "python", "python"),
    ("outer/f.py", "python", "python"), ("README.md", "unknown", "unknown"), ("Makefile", "unknown", "unknown"), ("a/b.tar.py3", "python", "unknown"), ("conf/app.toml", "unknown", "unknown"), ("dist/a.js", "javascript", "javascript"),
    ("doc/.hid/b.md", "unknown", "unknown"), ("build.rs", "rust", "rust"), ("p/q.swift", "unknown", "swift")]))
def languages(spark, d):
    return paths(spark).select("path", sources.language(F.col("path")).alias("language"), sources.display_language(F.col("path")).alias("shown"))


@query(f"WITH p AS ({PATHS_SQL}) SELECT path FROM p WHERE {EXT} IN ('{"', '".join((*sources.EXTENSIONS, *watch.CONFIG_EXTENSIONS))}') AND NOT regexp_matches(path, '^(target|node_modules|dist|build|\\.git|out)/') AND NOT regexp_matches('/' || path, '/\\.[^./]')")
def watched_paths(spark, d):
    return paths(spark).where(watch.watched(F.col("path")))


@query(values("channel_limit, rrf_k, rerank_top_n, tokenizer, at_root", [(7, 60, 10, "default", True)]))
def configuration(spark, d):
    import json
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as home:
        os.makedirs(f"{home}/.git")
        os.makedirs(f"{home}/a/b")
        with open(f"{home}/c.json", "w", encoding="utf-8") as f:
            json.dump({"channel_limit": 7, "tokenizer": "default", "other": 1}, f)
        c, none = sources.Config.load(f"{home}/c.json"), sources.Config.load(f"{home}/no.json")
        at_root = os.path.realpath(sources.project_root(f"{home}/a/b")) == os.path.realpath(home)
    return spark.createDataFrame([(c.channel_limit, none.rrf_k, c.rerank_top_n, c.tokenizer, at_root)], "channel_limit int, rrf_k int, rerank_top_n int, tokenizer string, at_root boolean")


@query(f"WITH g AS ({values('path, content', list(fixtures.SOURCES.items()))}) SELECT path, md5(content) AS md5, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM g")
def scanned_files(spark, d):
    """The sources written as a tree beside files and folders that are not scanned, and read by scan()."""
    import os
    import tempfile

    if not spark.sparkContext.master.startswith("local["):
        root = fixtures.folder(spark, "tree")
        put_tree(spark, root)
        return sources.scan(spark, root).select("path", "md5", "size")
    root = tempfile.mkdtemp(prefix="sparkloom-tree-", dir=os.environ.get("TMPDIR"))
    put_tree(spark, f"file://{root}")
    return sources.scan(spark, f"file://{root}").select("path", "md5", "size")


def put_tree(spark, root: str) -> None:
    jvm = spark.sparkContext._jvm
    extra = {"target/a.rs": "fn x() {}", ".git/b.py": "x = 1", "notes.txt": "text", "web/node_modules/c.js": "x()"}
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for path, content in (fixtures.SOURCES | extra).items():
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{path}"), True)
        stream.write(content.encode())
        stream.close()


# Text search


def bm25_sql(terms: str) -> str:
    return BM25.replace("'the', 'que', 'der', 'with'", terms)


@query(f"WITH {bm25_sql("'of', 'the'")} SELECT sc.doc_id AS id, round(score, 6) AS score FROM sc JOIN tok ON sc.doc_id = tok.doc_id WHERE concat(' ', array_to_string(t, ' '), ' ') LIKE '% of the %' ORDER BY round(score, 9) DESC, sc.doc_id LIMIT 30")
def bm25_phrase_retry(spark, d):
    """A query with an open quote: without it, its two words are looked for as a phrase."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return bm25.search(docs, "doc_id", '"of the', 30, {"content": "text"}, "default").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT 'limit 0' AS asked, doc_id AS id FROM (SELECT doc_id FROM sc ORDER BY round(score, 9) DESC, doc_id LIMIT 1)")
def bm25_limits(spark, d):
    """A limit of 0 is one of 1; a query without words finds nothing."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    none = bm25.search(docs, "doc_id", " *? ", 10, {"content": "text"}, "default")
    return bm25_docs(spark, d, 0).select(F.lit("limit 0").alias("asked"), "id").unionByName(none.select(F.lit("no words").alias("asked"), "id"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda t: length(t) <= 40) AS c, list_filter(regexp_extract_all(lower(coalesce(source, '')), '[\\p{L}\\p{N}]+'), lambda t: length(t) <= 40) AS s FROM documents),
f AS (SELECT doc_id, 'c' AS f, c AS t FROM t UNION ALL SELECT doc_id, 's', s FROM t), st AS (SELECT f, CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean FROM f GROUP BY f),
p AS (SELECT f, doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT f, doc_id, t, unnest(t) AS term FROM f) WHERE term IN ('the', 'src1') GROUP BY ALL), g AS (SELECT f, term, count(*) AS df FROM p GROUP BY ALL)
SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM p JOIN g USING (f, term) JOIN st USING (f) GROUP BY doc_id ORDER BY score DESC, id LIMIT 40""")
def bm25_two_fields(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    found = bm25.search(docs, "doc_id", "the src1", 100_000, {"content": "text", "symbol_name": "source"}, "default")
    return found.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(40)


@query("SELECT CAST(count(*) AS BIGINT) AS n, TRUE AS ready, CAST(count(*) FILTER (source <> 'src1') AS BIGINT) AS n_left FROM documents")
def text_search_provider(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("snippet_id"), F.col("source").alias("file_path"), "text")
    p = bm25.TableSearch({"content": "text"}, "default")
    p.index_chunks(docs)
    n, ready = p.document_count(), p.is_ready()
    p.remove_by_path("src1")
    return spark.createDataFrame([(n, ready, p.document_count())], "n long, ready boolean, n_left long")


@query(f"SELECT doc_id, CAST(length(trim(w, {WHITE_SQL})) >= 16 AS BOOLEAN) AS long_enough, round(CASE WHEN length(trim(w, {WHITE_SQL})) < 30 THEN 1 - (1 - length(trim(w, {WHITE_SQL})) / 30.0) * 0.5 ELSE 1.0 END, 6) AS weight FROM (SELECT doc_id, chr(9) || chr(13) || left(text, CAST(doc_id % 40 AS INTEGER)) || chr(160) || chr(10) AS w FROM documents)")
def penalty_with_white_space(spark, d):
    """Texts between tabs, carriage returns and hard spaces."""
    w = F.concat(F.lit("\t\r"), F.substring("text", F.lit(1), (F.col("doc_id") % 40).cast("int")), F.lit("\xa0\n"))
    return table(spark, d, "documents").select("doc_id", X.long_enough(w).alias("long_enough"), F.round(X.short_penalty(F.lit(1.0), w), 6).alias("weight"))


@query(f"SELECT doc_id, round(octet_length(encode(w)) / CAST(len(list_filter(string_split(w, chr(10)), lambda x: trim(x, {WHITE_SQL}) <> '')) AS DOUBLE), 6) AS width FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(9) || chr(13) || chr(10) || chr(160) || chr(10)) AS w FROM documents WHERE trim(text, {WHITE_SQL}) <> '')")
def width_with_blank_lines(spark, d):
    """Lines of tabs, carriage returns and hard spaces are blank."""
    w = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\t\r\n\xa0\n"))
    return table(spark, d, "documents").where(X.bare(F.col("text")) != "").select("doc_id", F.round(D.bytes_per_line(w), 6).alias("width"))


@query("SELECT CAST(page_id AS VARCHAR) || CASE page_id % 2 WHEN 0 THEN '.js' ELSE '.py' END AS path FROM pages WHERE page_id % 2 = 1 OR page_id % 4 = 0")
def skipped_scripts(spark, d):
    """Scripts that are compiled are skipped, other files are not looked at. Pages of odd number are Python here; every second script has a bundler's mark, the others few names."""
    code = F.when(F.col("page_id") % 4 == 0, F.lit("function a() {\n  return 1;\n}\n")).otherwise(F.lit("var _0x12 = 1;\n"))
    path = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".js").otherwise(".py"))
    return D.skip_compiled(table(spark, d, "pages").select(path.alias("path"), code.alias("content"))).select("path")


# Vectors and fusion


@query(f"SELECT doc_id, 64 AS dims, CAST(round(CASE WHEN trim(text, {WHITE_SQL}) = '' AND length(text) < 3 THEN 0 ELSE 1 END, 3) AS DOUBLE) AS length FROM documents WHERE text IS NOT NULL")
def embedded_texts(spark, d):
    """Every text has a vector of the provider's size and length 1."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("content"))
    e = vectors.embed(docs, vectors.HashingProvider(), "content")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("doc_id", F.size("vector").alias("dims"), F.round(norm, 3).alias("length"))


class CountingProvider:
    """Two numbers that SQL can tell: the text's length over 1000, and how often it has an e over 100."""

    model, dims = "counting", 2

    def embed(self, texts):
        return [[len(t) / 1000, t.count("e") / 100] for t in texts]


@query("SELECT doc_id, round(length(text) / 1000.0, 4) AS a, round((length(text) - length(replace(text, 'e', ''))) / 100.0, 4) AS b, source <> 'src4' AS was_cached FROM documents WHERE length(text) < 2000")
def embedded_with_cache(spark, d):
    """Texts of src4 are embedded now, the others come from the cache."""
    docs = table(spark, d, "documents").where("length(text) < 2000").select("doc_id", F.col("text").alias("content"), "source")
    p = CountingProvider()
    known = vectors.embed(docs.where("source <> 'src4'"), p, "content")
    cache = known.select(vectors.cache_key(p.model, F.col("content")).alias("hash"), "vector").dropDuplicates(["hash"])
    out, _ = vectors.embed_cached(docs, cache, p)
    return out.select("doc_id", F.round(F.col("vector")[0].cast("double"), 4).alias("a"), F.round(F.col("vector")[1].cast("double"), 4).alias("b"), (F.col("source") != "src4").alias("was_cached"))


KNN = f"nn AS (SELECT e.vec_id AS id, {DISTANCE} AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY round({DISTANCE}, 9), e.vec_id LIMIT 30)"


@query(f"WITH {KNN} SELECT id FROM nn WHERE id % 3 <> 0")
def knn_without_vanished(spark, d):
    """The best 30, less those of files that are gone."""
    hits = vectors.knn(vectors_of(spark, d), probe(spark, d), 30).withColumn("file_path", F.concat(F.lit("f"), F.col("id") % 3))
    return vectors.drop_vanished(hits, spark.createDataFrame([("f1",), ("f2",)], "path string")).select("id")


@query(f"WITH {KNN} SELECT id, CAST(CASE WHEN id % 2 = 0 THEN id ELSE id + 1000 END AS BIGINT) AS line_start, CAST(CASE WHEN id % 2 = 0 THEN id + 5 ELSE id + 1005 END AS BIGINT) AS line_end FROM nn WHERE id > 0")
def merged_lines(spark, d):
    """Lines of the dense channel, and where it has none (0) of the sparse one."""
    fused = vectors.knn(vectors_of(spark, d), probe(spark, d), 30).select("id", "score")
    even = F.col("id") % 2 == 0
    dense = fused.select("id", F.when(even, F.col("id")).otherwise(F.lit(0)).alias("line_start"), F.when(even, F.col("id") + 5).otherwise(F.lit(0)).alias("line_end"))
    sparse = fused.select("id", (F.col("id") + 1000).alias("line_start"), (F.col("id") + 1005).alias("line_end"))
    return fusion.merge_lines(fused.where("id > 0"), dense, sparse).select("id", "line_start", "line_end")


@query(f"WITH {KNN} SELECT id, round(1 / (1 + distance), 6) AS score, 'DenseOnly' AS source FROM nn")
def sparse_failure(spark, d):
    """Where the sparse channel fails, the dense hits come with their own scores."""
    dense = vectors.knn(vectors_of(spark, d), probe(spark, d), 30).select("id", "score")

    def broken():
        raise RuntimeError("no index")

    found, sparse = fusion.dense_and(dense, broken)
    assert sparse is None
    return fusion.dense_only(found).select("id", F.round("score", 6).alias("score"), "source")


def by_length(query, texts):
    """Scores texts by length; those that begin with a T get none."""
    return [None if t.startswith("T") else float(len(t)) for t in texts]


@query("""WITH h AS (SELECT doc_id AS id, length(text) % 97 AS score, text FROM (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id)), p AS (SELECT * FROM h ORDER BY score DESC, id LIMIT 50)
SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN text LIKE 'T%' THEN NULL ELSE length(text) END DESC NULLS LAST, score DESC, id) AS INTEGER) AS place FROM p ORDER BY place LIMIT 10""")
def reranked(spark, d):
    docs = table(spark, d, "documents").where("text is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("content"))
    hits = docs.select("id", (F.length("content") % 97).cast("double").alias("score"), "content")
    rows = [r["id"] for r in fusion.rerank(hits, "q", by_length, 10).select("id").collect()]
    return spark.createDataFrame(list(zip(rows, range(1, 11), strict=False)), "id long, place int")


# Maintenance


@query("SELECT p_partkey AS id, p_name AS name, p_size AS line FROM part")
def merged_missing(spark, d):
    """Rows that are there stay, and those that are not come from the fresh ones."""
    f = functions_of(spark, d).select("id", "name", F.col("line_start").alias("line"))
    return incremental.merge_missing(f.where("id % 3 <> 0"), f.withColumn("name", F.when(F.col("id") % 3 == 0, F.col("name")).otherwise("other")), ["id", "line"])


@query(f"""WITH {CALLS}, f AS (SELECT p_partkey AS id FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part))
SELECT (SELECT count(*) FROM f) AS n_functions, (SELECT count(*) FROM calls WHERE caller_id IN (SELECT id FROM f) AND callee_id IN (SELECT id FROM f)) AS n_calls""")
def file_removed_from_graph(spark, d):
    f = functions_of(spark, d)
    gone = f.agg(F.min("file_path").alias("path"))
    left, calls = incremental.remove_file_from_graph(f, calls_of(spark, d), gone)
    return spark.createDataFrame([(left.count(), calls.count())], "n_functions long, n_calls long")


@query(f"WITH {CALLS} SELECT 'functions' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM part UNION ALL SELECT 'calls', count(*), CAST(sum(callee_id) AS BIGINT) FROM calls")
def graph_saved_as_json(spark, d):
    """A graph written in both forms and read back from JSON."""
    f, c, out = functions_of(spark, d), calls_of(spark, d), fixtures.folder(spark, "graph")
    incremental.save_graph(f, c, out, "both")
    rf, rc = incremental.load_graph(spark, out, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in f.schema), ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in c.schema), "json")
    one = lambda df, name, c: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"))
    return one(rf, "functions", "id").unionByName(one(rc, "calls", "callee_id"))


@query("SELECT p_type AS language, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def compacted(spark, d):
    small = functions_of(spark, d).repartition(40)
    return incremental.compact(small, 500).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(values("step, n", [("versions", 2), ("after prune", 1), ("rows", 3)]))
def snapshot_versions(spark, d):
    """Two versions, of which the older one is pruned; the current one has the second writing's rows."""
    store = incremental.Snapshots(spark, fixtures.folder(spark, "snapshots"))
    for n in (2, 3):
        with store.exclusive():
            store.write({"t": spark.range(n)})
    count = lambda: sum(f.getPath().getName().startswith("v-") for f in store.fs.listStatus(store._path(store.root)))
    rows = [("versions", count())]
    store.prune()
    return spark.createDataFrame([*rows, ("after prune", count()), ("rows", store.read("t").count())], "step string, n int")


# Export


@query("""SELECT '    <node id="' || p_partkey || '"><data key="name">' || p_name || '</data><data key="file">' || p_brand || '</data></node>' AS line FROM part""")
def graphml_nodes(spark, d):
    return export.graphml(functions_of(spark, d), calls_of(spark, d).limit(0)).where("section = 1").select("line")


@query("""SELECT '      <node id="' || p_partkey || '" label="' || p_name || '"/>' AS line FROM part""")
def gexf_nodes(spark, d):
    return export.gexf(functions_of(spark, d), calls_of(spark, d).limit(0)).where("section = 1").select("line")


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def json_round_trip(spark, d):
    return export.from_json_rows(export.to_json_rows(functions_of(spark, d).select("id", "name")), "id long, name string")


# Knowledge


def knowledge_records(spark, d) -> DataFrame:
    """Conversations as records: a type and tags by turn and role, times by conversation."""
    c = table(spark, d, "conversations").where("text is not null").withColumn("key", F.concat_ws("-", "conv_id", "turn", F.md5(F.col("text").cast("binary")))).dropDuplicates(["key"])
    kind = F.when(F.col("turn") % 2 == 0, "repo_retrieval").otherwise("coding_modification")
    none = F.lit(None).cast("string")
    stamp = F.lpad(F.col("conv_id").cast("string"), 9, "0")
    empty = F.array().cast("array<string>")
    return knowledge.sanitise(c.select(
        F.col("key").alias("id"), F.col("role").alias("title"), F.col("text").alias("content"), kind.alias("type"), F.array("role").alias("tags"), empty.alias("related_files"), F.lit("repo_agent").alias("source_agent"),
        none.alias("task_id"), F.lit(0.8).cast("float").alias("confidence"), F.lit(0).alias("access_count"), stamp.alias("created_at"), stamp.alias("updated_at"), none.alias("last_accessed"), empty.alias("parent_ids"),
    ))


RECORDS = """k AS (SELECT DISTINCT concat_ws('-', conv_id, turn, md5(text)) AS id, role, left(text, 500) AS content, CASE turn % 2 WHEN 0 THEN 'repo_retrieval' ELSE 'coding_modification' END AS type, conv_id FROM conversations WHERE text IS NOT NULL)"""


@query(f"WITH {RECORDS} SELECT id, type FROM k WHERE type = 'repo_retrieval' AND role = 'user' ORDER BY conv_id DESC, id LIMIT 20")
def knowledge_listed(spark, d):
    return knowledge.KnowledgeBase(spark, knowledge_records(spark, d)).list(20, "repo_retrieval", "user").select("id", "type")


@query(f"WITH {RECORDS} SELECT type, CAST(count(*) AS BIGINT) AS n FROM k WHERE id <> (SELECT min(id) FROM k) GROUP BY type UNION ALL SELECT 'coding_modification', 0 WHERE FALSE")
def knowledge_deleted(spark, d):
    base = knowledge.KnowledgeBase(spark, knowledge_records(spark, d))
    base.delete(base.records.agg(F.min("id")).first()[0])
    return base.records.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(values("title, content, type, refused", [("t" * 30, "c" * 500, "repo_retrieval", 2)]))
def knowledge_added(spark, d):
    base, refused = knowledge.KnowledgeBase(spark), 0
    base.add("t" * 31, "c" * 501, "repo_retrieval", 1_700_000_000_000, tags=["x"])
    for kind, agent in (("other", "repo_agent"), ("repo_retrieval", "other")):
        try:
            base.add("a", "b", kind, 0, source_agent=agent)
        except ValueError:
            refused += 1
    return base.records.select("title", "content", "type", F.lit(refused).alias("refused"))


DENSE = f"""{RECORDS}, r AS (SELECT * FROM k WHERE type = 'repo_retrieval'), q AS (SELECT 7 / 1000.0 AS a, 1 / 100.0 AS b),
dd AS (SELECT id, (a - (SELECT a FROM q)) * (a - (SELECT a FROM q)) + (b - (SELECT b FROM q)) * (b - (SELECT b FROM q)) AS distance FROM (
  SELECT id, CAST(CAST((length(role) + 1 + length(content)) / 1000.0 AS FLOAT) AS DOUBLE) AS a, CAST(CAST((length(role || content) - length(replace(role || content, 'e', ''))) / 100.0 AS FLOAT) AS DOUBLE) AS b FROM r)),
dn AS (SELECT id, row_number() OVER (ORDER BY 1 / (1 + distance) DESC, id) AS rank FROM (SELECT * FROM dd ORDER BY round(distance, 9), id LIMIT 32))"""


def stored_knowledge(spark, d) -> knowledge.KnowledgeBase:
    """The records in a store of their own, with vectors made when they were added."""
    base = knowledge.KnowledgeBase(spark, provider=CountingProvider(), store=fixtures.folder(spark, "knowledge"))
    base.add_records(knowledge_records(spark, d))
    return base


@query(f"WITH {DENSE} SELECT id, CAST(rank AS INTEGER) AS rank FROM dn")
def knowledge_dense_channel(spark, d):
    """The dense side of the search: records of the domain's types, by the stored vectors of title and content."""
    base = stored_knowledge(spark, d)
    inside = base.vectors.join(base.records.where(F.col("type").isin(knowledge.types_of(["repo"]))).select("id"), "id", "left_semi")
    dense = vectors.knn(inside, base.provider.embed(["the ink"])[0], 32).select("id", "score")
    return fusion.ranked(dense, "dense", [F.desc("score"), "id"]).select("id", "rank")


@query(f"""WITH {DENSE}, u AS (SELECT id, type, role AS t FROM k), f AS (SELECT id, type, 'title' AS f, {CODE_TOKENS.replace('text', 'role')} AS t FROM k UNION ALL SELECT id, type, 'content', {CODE_TOKENS.replace('text', 'content')} FROM k),
st AS (SELECT f, CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean FROM f GROUP BY f), ps AS (SELECT f, id, type, len(t) AS dl, term, count(*) AS tf FROM (SELECT f, id, type, t, unnest(t) AS term FROM f) WHERE term IN ('the', 'ink') GROUP BY ALL),
g AS (SELECT f, term, count(*) AS df FROM ps GROUP BY ALL), sc AS (SELECT id, type, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM ps JOIN g USING (f, term) JOIN st USING (f) GROUP BY ALL),
sp AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM sc WHERE type = 'repo_retrieval' ORDER BY round(score, 9) DESC, id LIMIT 32))
SELECT id, round(coalesce(1 / (60.0 + dn.rank), 0) + coalesce(1 / (60.0 + sp.rank), 0), 6) AS score FROM dn FULL JOIN sp USING (id) ORDER BY coalesce(1 / (60.0 + dn.rank), 0) + coalesce(1 / (60.0 + sp.rank), 0) DESC, id LIMIT 8""")
def knowledge_search(spark, d):
    return stored_knowledge(spark, d).search("the ink", 8, ["repo"]).select("id", F.round("score", 6).alias("score"))


# Streaming


@query("SELECT user_id AS project, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IN ('purchase', 'click') GROUP BY user_id")
def streamed_events(spark, d):
    """Events as JSON files, read as a stream, filtered by kind, and counted behind all micro-batches."""
    folder = fixtures.folder(spark, "events")
    e = table(spark, d, "events").select(F.concat(F.lit("src/a"), "event_id", F.lit(".py")).alias("path"), F.when(F.col("event_type") == "purchase", "Create").when(F.col("event_type") == "click", "Modify").otherwise("Access").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("project"))
    e.repartition(3).write.json(f"{folder}/in")
    kept = watch.of_kinds(watch.read_events(spark, f"{folder}/in")).where(watch.watched(F.col("path")))
    run = kept.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("project").cast("long").alias("project")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), b AS (SELECT user_id, k, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k)
SELECT CAST(user_id AS VARCHAR) AS project, CAST(n AS BIGINT) AS n_events FROM b WHERE last_ts + INTERVAL 2 HOUR < (SELECT max(ts) FROM events)""")
def streamed_bursts(spark, d):
    """Bursts of a stream: those that ended before the watermark, which stands at the last event."""
    folder = fixtures.folder(spark, "bursts")
    e = table(spark, d, "events").select(F.lit("src/a.py").alias("path"), F.lit("Modify").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("project"))
    e.coalesce(1).write.json(f"{folder}/in")
    bursts = watch.debounce_stream(watch.read_events(spark, f"{folder}/in"), "2 hours", "0 seconds")
    run = watch.on_burst_into(bursts, f"{folder}/out", f"{folder}/state")
    run.awaitTermination()
    return spark.read.schema("project string, n_events long").parquet(f"{folder}/out").select("project", "n_events")
