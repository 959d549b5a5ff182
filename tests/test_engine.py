import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import detect, text
from sparkloom.operators import bm25, export, fusion, incremental, knowledge, resolve, vectors
from sparkloom.plans import api
from sparkloom.sources import files as sources


@pytest.mark.parametrize(
    ("code", "kind", "reason"),
    [
        ("", "Empty", "empty"),
        (" \n\t ", "Empty", "empty"),
        ("const __webpack_require__ = 1;", "CompiledCode", "fingerprint: __webpack_require__"),
        ("x" * 251, "CompiledCode", "line length"),
        ("x" * 250, "SourceCode", "few identifiers"),
        ("ab " * 49, "SourceCode", "few identifiers"),
        ("\n".join(["ab"] * 55 + ["long"] * 45), "SourceCode", "source"),
        ("\n".join(["ab"] * 56 + ["long"] * 44), "CompiledCode", "short identifiers"),
    ],
)
def test_detector(spark, code, kind, reason):
    row = detect.detect(spark.createDataFrame([(code,)], "content string")).first()
    assert (row.code_type, row.reason) == (kind, reason)


def test_tokens(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.code_tokens(F.lit("parseHTTPRequest snake_case x"))) == ["parse", "h", "t", "t", "p", "request", "parsehttprequest", "snake", "case", "snake_case", "x"]
    assert one(text.default_tokens(F.lit("Été-42 " + "y" * 41))) == ["été", "42"]
    assert one(text.line_range(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert one(text.line_range(F.lit("a"), F.lit(2), F.lit(3))) is None
    assert one(text.truncate_bytes(F.lit("aéé"), 4)) == "aé"
    assert one(text.short_penalty(F.lit(1.0), F.lit("x" * 15))) == 0.75


def test_language_tables(spark):
    rows = [("a/b.RS",), ("x.pyw",), ("y.tpp",), ("noext",), (".hidden/z.go",), ("target/q.rs",), ("src/targets/q.rs",)]
    got = spark.createDataFrame(rows, "path string").select("path", sources.language(F.col("path")), sources.display_language(F.col("path")), sources.supported(F.col("path")), sources.scanned(F.col("path"))).collect()
    assert [tuple(r)[1:] for r in got] == [("rust", "rust", True, True), ("unknown", "python", False, True), ("unknown", "unknown", True, True), ("unknown", "unknown", False, True), ("go", "go", True, False), ("rust", "rust", True, False), ("rust", "rust", True, True)]


def test_incremental_equals_full(spark):
    v1 = [("a", "1"), ("b", "2"), ("c", "3")]
    v2 = [("a", "1"), ("b", "x"), ("d", "4")]
    old, new = (spark.createDataFrame(v, "path string, content string") for v in (v1, v2))
    status = incremental.classify(incremental.hashes(old), incremental.hashes(new))
    assert dict(status.collect()) == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    out = incremental.replace_files(old, new.join(status.where("status in ('new','changed')"), "path", "left_semi"), status.where("status <> 'unchanged'"), "path")
    assert sorted(map(tuple, out.collect())) == sorted(v2)


def test_snapshots(spark, tmp_path):
    s = incremental.Snapshots(spark, f"file://{tmp_path}/s")
    assert s.current() is None
    assert s.read("t", "x int").count() == 0
    s.write({"t": spark.createDataFrame([(1,)], "x int")})
    s.write({"t": s.read("t").union(spark.createDataFrame([(2,)], "x int"))})
    assert s.read("t").count() == 2
    assert s.prune() == 1
    s.drop()
    assert s.current() is None


def test_fusion(spark):
    dense = spark.createDataFrame([("a", 1, "dense"), ("b", 2, "dense")], "id string, rank int, channel string")
    sparse = spark.createDataFrame([("b", 1, "sparse"), ("c", 2, "sparse")], "id string, rank int, channel string")
    got = {r["id"]: (round(r["score"], 6), r["source"]) for r in fusion.rrf([dense, sparse]).collect()}
    assert got == {"a": (round(1 / 61, 6), "DenseOnly"), "b": (round(1 / 61 + 1 / 62, 6), "Fused"), "c": (round(1 / 62, 6), "SparseOnly")}
    hits = spark.createDataFrame([("a", 3.0, "x" * 40), ("b", 2.0, "y" * 40), ("c", 1.0, "z" * 40)], "id string, score double, content string")
    assert [r["id"] for r in fusion.rerank(hits, "q", lambda q, t: [float(x[0] == "z") for x in t], 2).collect()] == ["c", "a"]

    def fails(q, t):
        raise OSError

    assert [r["id"] for r in fusion.rerank(hits, "q", fails, 2).collect()] == ["a", "b"]
    lines = fusion.merge_lines(hits.select("id", "score"), spark.createDataFrame([("a", 0, 0)], "id string, line_start int, line_end int"), spark.createDataFrame([("a", 3, 9)], "id string, line_start int, line_end int"))
    assert lines.where("id = 'a'").select("line_start", "line_end").first() == (3, 9)


def test_enclosing_function(spark):
    f = spark.createDataFrame([("out", "f", 1, 900), ("in", "f", 300, 400)], "id string, file_path string, line_start int, line_end int")
    c = spark.createDataFrame([(1, "f", 350), (2, "f", 600), (3, "f", 901), (4, "g", 1)], "call_id int, file_path string, line int")
    assert dict(resolve.enclosing(c, f).select("call_id", "fn_id").collect()) == {1: "in", 2: "out", 3: None, 4: None}
    assert dict(resolve.enclosing(c, f, how="outermost").select("call_id", "fn_id").collect())[1] == "out"


def test_guessed_calls(spark):
    f = spark.createDataFrame([("1", "main", "f", 1), ("2", "load", "f", 2), ("3", "test_load", "f", 3), ("4", "load", "g", 1)], "id string, name string, file_path string, line_start int")
    assert {(r["caller_id"], r["callee_id"]) for r in resolve.guessed_calls(f).collect()} == {("1", "2"), ("1", "3"), ("3", "2")}


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([("a", "fn one"), ("b", "fn two"), ("c", "fn one")], "id string, content string")
    p = vectors.HashingProvider(8)
    empty = spark.createDataFrame([], "hash string, vector array<float>")
    out, fresh = vectors.embed_cached(chunks, empty, p)
    assert (out.count(), fresh.count()) == (3, 2)
    assert vectors.embed_cached(chunks, fresh, p)[1].count() == 0
    assert vectors.of_dims(out, 9).count() == 0
    best = vectors.knn(out, p.embed(["fn two"])[0], 1).first()
    assert best["id"] == "b"
    assert best["score"] == pytest.approx(1.0, abs=1e-6)


def test_knn_join_against_knn(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    got = vectors.knn_join(v.where("id < 3").withColumnRenamed("id", "query_id"), v, 4, block_bytes=48)
    for q in range(3):
        want = [round(r["distance"], 6) for r in vectors.knn(v, rows[q][1], 4).collect()]
        assert [round(r["distance"], 6) for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want


def test_bm25_phrase_and_fallback(spark):
    d = spark.createDataFrame([("1", "open the file"), ("2", "the open file"), ("3", "")], "id string, text string")
    assert [r[0] for r in bm25.phrase(d, "id", "text", "the file").collect()] == ["1"]
    assert {r["id"] for r in bm25.search(d, "id", '"open*"', 0, {"c": "text"}).collect()} <= {"1", "2"}
    assert bm25.search(d, "id", "", 5, {"c": "text"}).count() == 0


def test_knowledge_base(spark):
    kb = knowledge.KnowledgeBase(spark)
    a = kb.add("t" * 31, "how retries work", "repo_retrieval", 1000, tags=["net"])
    kb.add("caching", "how the cache works", "coding_modification", 2000, source_agent="coding_agent")
    assert kb.records.where(F.length("title") == 30).count() == 1
    with pytest.raises(ValueError):
        kb.add("x", "y", "unknown", 1)
    with pytest.raises(ValueError):
        kb.add("x", "y", "repo_retrieval", 1, source_agent="")
    assert [kb.search("how", domains=d).count() for d in (("repo",), ("coding",), ("repo", "coding"), ())] == [1, 1, 2, 2]
    assert kb.list(tag="net").count() == kb.list(type="repo_retrieval").count() == 1
    kb.delete(a)
    assert kb.list().count() == 1
    assert kb.search("  ").count() == 0


def test_exports(spark):
    f = spark.createDataFrame([("1", 'a<"b', "f")], "id string, name string, file_path string")
    c = spark.createDataFrame([("1", None, "gone", 3, False)], "caller_id string, callee_id string, callee_name string, line_number int, is_resolved boolean")
    assert [r[0] for r in export.dot_edges(c).collect()] == ['  "1" -> "gone" [style=dashed];']
    import xml.etree.ElementTree as ET

    for make in (export.graphml, export.gexf):
        lines = [r["line"] for r in make(f, c).orderBy("section", "at").collect()]
        ET.fromstring("\n".join(lines).encode())
    rows = export.to_json_rows(f)
    assert export.from_json_rows(rows, "id string, name string, file_path string").collect() == f.collect()


def test_index_from_scan_to_search(spark, tmp_path):
    src = tmp_path / "src"
    for name, code in {"a.py": "def load():\n    return parse_config()\n\ndef parse_config():\n    return {'a': 1, 'b': 2}\n", "lib/b.rs": "fn run() {\n    load();\n}\n", "node_modules/c.js": "function no() {}", "min.js": "var _0x1=1;"}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(code)
    out = f"file://{tmp_path}/index"
    stats = api.build_index(spark, f"file://{src}", out)
    assert (stats.new, stats.changed, stats.unchanged, stats.deleted) == (2, 0, 0, 0)
    index = api.Index(spark, out)
    assert {r["name"] for r in index.functions.collect()} == {"load", "parse_config", "run"}
    assert [r["caller"] for r in api.callers(index, "load").collect()] == ["run"]
    assert [r["callee"] for r in api.callees(index, "load").collect()] == ["parse_config"]
    assert "parse_config" in {r["symbol_name"] for r in api.search(index, "parse config", 2).collect()}
    assert api.callgraph(index, "run", 2, "dfs_tree")["callees"] == [{"name": "load", "children": [{"name": "parse_config", "children": []}]}]
    assert {(r["name"], r["depth"]) for r in api.callgraph(index, "run", 2).collect()} == {("load", 1), ("parse_config", 2)}
    assert api.snippet(index, "run", "b.rs")["data"]["line_end"] == 3
    assert not api.snippet(index, "nothing")["success"]
    assert json.loads(api.skeletons(index, ["lib/b.rs", "zz.py"]).first()[0])["data"]["skeletons"][0]["skeleton_text"] == "fn run() { ... }"
    assert [r["code_snippet"] for r in api.neighbour_snippets(index, "load").collect()] == ["fn run() {\n    load();\n}"]
    assert api.search_entities(index, "run").first()["kind"] == "function"
    assert api.repository_stats(index).first()["total_functions"] == 3
    assert index.postings.where("term = 'parse'").count() > 0
    (src / "a.py").write_text("def load():\n    return 2\n")
    (src / "lib/b.rs").unlink()
    stats = api.build_index(spark, f"file://{src}", out)
    assert (stats.new, stats.changed, stats.unchanged, stats.deleted) == (0, 1, 0, 1)
    assert {r["name"] for r in api.Index(spark, out).functions.collect()} == {"load"}
    assert api.status(api.Index(spark, out)).first()["total_files"] == 1
    assert api.projects(spark, f"file://{tmp_path}").count() == 1
    api.drop_index(spark, out)
    assert api.projects(spark, f"file://{tmp_path}").count() == 0


def test_a_stored_knowledge_base_embeds_once(spark, tmp_path):
    from sparkloom.operators import knowledge, vectors

    seen = tmp_path / "seen"

    class Provider(vectors.HashingProvider):
        def embed(self, texts):
            with open(seen, "a", encoding="utf-8") as f:
                f.writelines(f"{t}\n" for t in texts)
            return super().embed(texts)

    base = knowledge.KnowledgeBase(spark, provider=Provider(8), store=f"file://{tmp_path}/kb")
    one = base.add("alpha", "first words", "repo_retrieval", 1000)
    two = base.add("beta", "other words", "coding_modification", 2000)
    again = knowledge.KnowledgeBase(spark, provider=Provider(8), store=f"file://{tmp_path}/kb")
    assert {r["id"] for r in again.search("words", 5).collect()} == {one, two}
    assert [r["id"] for r in again.search("words", 5, ["repo"]).collect()] == [one]
    again.delete(one)
    base.reload()
    assert [r["id"] for r in base.records.collect()] == [r["id"] for r in base.vectors.collect()] == [two]
    texts = seen.read_text().splitlines()
    assert texts.count("alpha first words") == texts.count("beta other words") == 1


def test_writers_take_turns(spark, tmp_path):
    from sparkloom.operators import incremental

    a, b = (incremental.Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    with a.exclusive():
        with pytest.raises(TimeoutError), b.exclusive(wait=0.3):
            pass
    with b.exclusive(wait=0.3):
        b.write({"t": spark.range(3)})
    with a.exclusive(), b.exclusive(wait=1, stale=-1):
        pass
    old = a.current()
    a.write({"t": spark.range(4)})
    assert a.prune(3600) == 0 and a.prune() == 1 and a.current() != old


def test_knn_join_ties_and_blocks(spark):
    from sparkloom.operators import vectors

    v = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(90)], "id long, vector array<float>").repartition(7)
    q = v.where("id < 9").withColumnRenamed("id", "query_id")
    for size in (1 << 20, 40):
        got = vectors.knn_join(q, v, 5, block_bytes=size).collect()
        assert {(r["query_id"], r["rank"]): r["id"] for r in got} == {(i, k + 1): i % 3 + 3 * k for i in range(9) for k in range(5)}
    assert vectors.knn_join(q.limit(0), v, 5).count() == 0


def test_knn_join_orders_ties_of_rounded_distances_by_id(spark):
    from sparkloom.operators import vectors

    # 1 is farther than 2 by 1e-12, which the SQL rounds away; many more rows than one block of distances
    rows = [(1, [1.0, 1e-6]), (2, [1.0, 0.0])] + [(i, [2.0 + i % 5, 3.0]) for i in range(3, 3000)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, vector array<double>")
    got = vectors.knn_join(q, v, 4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 5, 10]


def test_provider_hashes_each_part_once(monkeypatch):
    import hashlib

    from sparkloom.operators import vectors

    def plain(text, dims):
        low, v = text.lower(), [0.0] * dims
        for x in [*low.split(), *(low[i : i + 3] for i in range(len(low) - 2))]:
            h = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            v[h % dims] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        return [x / norm for x in v]

    texts = ["", "a", "Ab", "the cat the cat", "İß 你好世界\U0001f600", "\ud800 x", "ab" * 500]
    want = [plain(t, 16) for t in texts]
    assert vectors.HashingProvider(16).embed(texts) == want
    assert vectors.HashingProvider(16, most_known=2).embed(texts) == want
    made, real = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda *a, **k: made.append(1) or real(*a, **k))
    vectors.HashingProvider(16).embed([texts[-1]] * 3)
    assert len(made) == 3


def test_embed_in_slices(spark):
    from sparkloom.operators import vectors

    df = spark.createDataFrame([(i, None if i == 3 else f"text {i}", [0.5]) for i in range(100)], "id long, content string, vector array<float>").coalesce(1)
    p = vectors.HashingProvider(8)
    got = vectors.embed(df, p, "content", batch=7, batch_bytes=1)
    assert got.columns == ["id", "content", "vector"]
    for r in got.collect():
        assert r["vector"] == pytest.approx(p.embed([r["content"] or ""])[0], abs=1e-6)
    assert vectors.embed(df.where("id < 0"), p, "content").count() == 0
