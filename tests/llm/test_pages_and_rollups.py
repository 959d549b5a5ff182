"""HTML extraction, WARC archives, rollups and the pipeline."""

import io

import pytest

from sparkloom.llm import html_text, rollups, warc
from sparkloom.llm.common import fresh_path

PAGE = "page_id long, url string, html string, text string, path string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGE)


ARTICLE = """<html><head><title>x</title><style>p{}</style></head><body><header>Site</header><nav><a>menu</a></nav>
<div class="cookie-notice">We use</div><main><article><header><h1>T &amp; q&nbsp;&#233;</h1></header><p>One <b>two</b>
 three<!-- no --></p><ul><li>a<li>b</ul><div class="adBox">buy</div><p>last<p>open<br>line<form><p>mail</p></form>
<section class="comments"><p>nice!</p></section><table><tr><td>1<td>2</table></article></main><aside>side</aside>
<script>var a="<p>no</p>"</script><footer>f</footer></body></html>"""
TEXT = "T & q é\n\nOne two three\n\na\n\nb\n\nlast\n\nopen line\n\n1\n\n2"
HARD = [(1, None, None), (2, "http://h/a", ""), (3, "not a url", "<p>plain"), (3, "not a url", "<p>plain"), (None, "http://h/b", "<"), (5, "http://h/c", "a < b <b>c</b"), (6, "//x@H:8/", "<div>" * 3000 + "deep"), (7, "http://h/d", "<!-- open <p>x"), (8, "http://h/e", "<script>never closed <p>x")]


def test_article_text():
    assert "\n\n".join(b[1] for b in html_text.candidates(html_text.Page(ARTICLE))) == TEXT
    assert html_text.host_of("HTTP://u@Ex.com:80/a") == "ex.com"
    assert html_text.words_of("siteNav no-ads") == ["site", "nav", "no", "ads"]
    assert [html_text.cuts(x)[0] for x in ("sidebar-left", "adBox", "has-sidebar", "social-science", "copyright-law", "entry-header", "header-image")] == [True, True, *[False] * 5]
    page = html_text.Page('<body class="with-sidebar"><div id="content" class="no-sidebar"><h1>A</h1>b<div class="sidebar">c</div></div><div role="search">d</div>')
    assert [b[1] for b in html_text.candidates(page)] == ["A", "b"]


MARKED = "<article><h1>T</h1><p>text</p></article>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<p title="a hidden gem">text</p>', ["text"]),
        ("<p title='class=ad id=nav'>text</p>", ["text"]),
        (f'<div class="layout sidebar-left">{MARKED}<div class="sidebar">s</div></div>', ["T", "text"]),
        (f'<div id="page" class="header-image">{MARKED}</div>', ["T", "text"]),
        (f'<div class="social-science">{MARKED}</div>', ["T", "text"]),
        (f'<div class="copyright-law">{MARKED}</div>', ["T", "text"]),
        (f'<section class="search results">{MARKED}</section>', ["T", "text"]),
        (f'<div class="alert">{MARKED}</div>', ["T", "text"]),
        ('<div class="alert"><p>all the text there is</p></div><div class="alert">no</div>', ["all the text there is"]),
        ('<section id="comments"><article>nice</article></section><article>a</article>', ["a"]),
        ('<article><header class="entry-header"><h1>T</h1></header><p>text</p></article>', ["T", "text"]),
        ('<article><header><h1>T</h1></header><p>text</p></article>', ["T", "text"]),
        ('<article><div class="header"><h1>T</h1></div><p>text</p><div class="social">no</div></article>', ["T", "text"]),
        ('<div class="banner"><h1>Site</h1></div><article>a</article>', ["a"]),
        ('<div class="masthead"><h1>Site</h1></div><div>longer text without a mark</div>', ["longer text without a mark"]),
        ('<p class="a" class="nav" data-x="' + "class=nav " * 3000 + '">a</p>', ["a"]),
        ("<div role='main'>a</div><p>b</p>", ["a", "b"]),
        ('<div data-role="main">a</div><p>b</p>', ["a", "b"]),
        ("<!--><p>a</p><!---><p>b</p><!-- x --!><p>c</p>", ["a", "b", "c"]),
        ("<p>one <button>no</button>two <img alt='hidden'>three <script>x()</script>four</p>", ["one two three four"]),
        ("<p>one <button><div>no</button> two <svg><g><text>no</svg> three</p><p>b", ["one two three", "b"]),
        ('<article>a<p>b <meta itemprop="x">c</p></article><article class="related-post">no</article><main class="sidebar-left">d</main>', ["a", "b c", "d"]),
        ("<p>a<hr>b<p hidden>c</p><p aria-hidden='true'>d</p><p style='display: none'>e</p>", ["a", "b"]),
    ],
)
def test_names_and_attributes(source, want):
    assert [b[1] for b in html_text.Page(source).blocks] == want


def test_marks_of_the_main_part():
    assert html_text.Page("<div role='main'>a</div>").has_main and html_text.Page('<div role="MAIN">a</div>').has_main
    assert not html_text.Page('<div data-role="main" title="role=main">a</div>').has_main


def tree_importance(pages, gamma=0.9):
    """Composite importance of one host's nodes by recursion, from (blocks, shapes) of its distinct pages."""
    import math
    from collections import Counter, defaultdict

    m, blocks, styles = len(pages), defaultdict(Counter), defaultdict(Counter)
    for p in pages:
        for path, text in {(path, text) for path, text, _ in p.blocks}:
            blocks[path][text] += 1
        for path, kids in {(path, kids) for path, kids in p.shapes if kids}:
            styles[path][kids] += 1

    def content(path):
        return 1 - sum(math.log(c) / math.log(m) for c in blocks[path].values()) / len(blocks[path])

    def of(path):
        s = styles[path]
        n = sum(s.values())
        node = -sum(c / n * math.log(c / n, n) for c in s.values()) if n > 1 else 1
        if set(s) == {"#"}:
            return content(path)
        below = 0
        for kids, c in s.items():
            parts = [content(path) if k == "#" else of(f"{path}>{k}") if f"{path}>{k}" in styles else 0 for k in kids.split(",")]
            below += c / n * sum(parts) / len(parts)
        return (1 - gamma ** len(s)) * node + gamma ** len(s) * below

    return {path: of(path) for path in styles if path}


def test_importance_goes_up_level_by_level(spark):
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(4), []

    def part(depth):
        if depth == 3 or rng.random() < 0.3:
            return "".join(f"<p>{rng.choice(['same', 'often', f'x{rng.random()}'])}</p>" for _ in range(rng.randint(1, 3)))
        return rng.choice(["", "own text"]) + "".join(f"<div class={rng.choice('abc')}>{part(depth + 1)}</div>" for _ in range(rng.randint(1, 2)))

    rows = [(i, "http://h/x", part(0)) for i in range(30)]
    want = tree_importance([html_text.Page(h) for h in dict.fromkeys(r[2] for r in rows)])
    per = html_text.statistics(pages(spark, rows)).distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("c"), F.first("kids").alias("kids"))
    m = len({r[2] for r in rows})
    content = per.where("kind = 0").groupBy("host", "path").agg((1 - F.avg(F.log("c") / F.log(F.lit(m)))).alias("content"))
    got = {r["path"]: r["importance"] for r in html_text.composite(per.where("kind = 1"), content, 0.9).collect()}
    assert got.keys() == want.keys() and len(want) > 8
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("broadcast_rows", [300_000, -1])
def test_repeated_branches_are_cut_and_articles_stay(spark, broadcast_rows):
    site = lambda i: (i, "http://site.org/p", f"<body><div class='top'><p>Welcome to the site</p></div><div class='story'><p>Story {i} is about {i * 7}</p><p>It goes on {i}</p></div><div class='end'><p>All rights</p></div></body>")
    rows = [site(i) for i in range(12)] + [(50 + i, "http://site.org/q", ARTICLE) for i in range(6)] + [(90, "http://lone.org", site(90)[2])]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages(spark, rows), broadcast_rows=broadcast_rows).collect()}
    assert all(got[i][0] == f"Story {i} is about {i * 7}\n\nIt goes on {i}" for i in range(12))
    assert all(got[50 + i] == (TEXT, len(TEXT)) for i in range(6))
    assert got[90][0].startswith("Welcome to the site")


@pytest.mark.parametrize("broadcast_rows", [300_000, -1])
def test_the_tree_judges_inside_and_beside_marked_articles(spark, broadcast_rows):
    notice = lambda i: (i, "http://a.org/p", f"<body><article><h1>Title {i}</h1><p>Body {i}</p><p>Read our <b>letter</b></p></article></body>")
    beside = lambda i, host: (i, f"http://{host}/p", f"<body><div>Body {i}</div><div>Our site</div><article><p>Teaser {i}</p></article></body>")
    again = lambda i: (i, "http://c.org/p", f"<body><article><p>Same story</p><p>Same end</p></article><div>Seen {i}</div></body>")
    rows = [notice(i) for i in range(12)] + [beside(i, "b.org") for i in range(20, 32)] + [again(i) for i in range(40, 52)] + [beside(60, "lone.org")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows), broadcast_rows=broadcast_rows).collect()}
    assert all(got[i] == f"Title {i}\n\nBody {i}" for i in range(12))
    assert all(got[i] == f"Body {i}\n\nTeaser {i}" for i in range(20, 32))
    assert all(got[i] == f"Same story\n\nSame end\n\nSeen {i}" for i in range(40, 52))
    assert got[60] == "Teaser 60"


@pytest.mark.parametrize("broadcast_rows", [300_000, -1])
def test_hard_pages(spark, broadcast_rows):
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html_text.extract(pages(spark, HARD), broadcast_rows=broadcast_rows).collect()), key=str)
    want = {1: "", 2: "", 3: "plain", None: "<", 5: "a < b c</b", 6: "deep", 7: "", 8: ""}
    assert got == sorted([(i, u, want[i]) for i, u, _ in HARD], key=str)
    assert html_text.extract(pages(spark, [])).count() == 0


# WARC


def test_archive_round_trip():
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, b"")
    records = [warc.record_bytes(1, "http://a/é", "<p>é".encode()), warc.record_bytes(2, None, b"", 1, True)]
    for r in records:
        w.write(r)
    assert list(warc.read_archive(io.BytesIO(out.getvalue()), chunk=7)) == records
    row = warc.parse_record(records[0])
    assert row[:5] == (1, "http://a/é", "response", None, 5) and row[6] == "<p>é".encode()
    assert warc.parse_record(records[1])[2:5] == ("revisit", 1, 0)


def test_a_compressed_dictionary_and_many_small_frames():
    import struct

    import zstandard

    records = [warc.record_bytes(i, f"http://a/{i}", b"<p>same words on every page %d" % i * (1 + i % 7)) for i in range(500)]
    raw = zstandard.train_dictionary(2048, records).as_bytes()
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, raw)
    for r in records:
        w.write(r)
    packed = zstandard.ZstdCompressor().compress(raw)
    other = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + out.getvalue()[8 + len(raw) :]
    for chunk in (64, 5000, 1 << 20):
        assert list(warc.read_archive(io.BytesIO(out.getvalue()), chunk)) == records
        assert list(warc.read_archive(io.BytesIO(other), chunk)) == records


def test_empty_and_long_pages_and_the_same_dictionary(spark):
    none = pages(spark, [])
    assert warc.read_archives(warc.write_archives(none, fresh_path(spark, "w"), warc.train_dictionary(none))).count() == 0
    rows = [(i, "u", f"<p>page {i} of the site " * (20_000 if i == 7 else 1 + i % 5)) for i in range(60)] * 2
    a, b = (warc.train_dictionary(pages(spark, rows).repartition(n)) for n in (2, 5))
    assert a == b and len(a) > 0
    got = warc.read_archives(warc.write_archives(pages(spark, rows), fresh_path(spark, "w"), a)).where("page_id = 7").collect()
    assert [r["payload_bytes"] for r in got] == [len(rows[7][2])] * 2


@pytest.mark.parametrize("damage", [lambda r: r.replace(b"WARC/1.1", b"WARC/9.9", 1), lambda r: r[:-1], lambda r: r.replace(b"<p>", b"<q>"), lambda r: r.replace(b"WARC-Date", b"WARC-Dato"), lambda r: r + b"x", lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: other")])
def test_broken_records_are_found(damage):
    with pytest.raises(warc.WarcError):
        warc.parse_record(damage(warc.record_bytes(1, "u", b"<p>x")))


@pytest.mark.parametrize("cut", [3, 20, -5])
def test_broken_archives_are_found(cut):
    import zstandard

    out = io.BytesIO()
    warc.ArchiveWriter(out, b"d" * 100).write(warc.record_bytes(1, "u", b"x" * 400))
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.read_archive(io.BytesIO(out.getvalue()[:cut])))


@pytest.mark.parametrize(("broadcast_rows", "least"), [(200_000, 0), (0, 0), (200_000, 6)])
def test_pages_through_archives(spark, broadcast_rows, least):
    rows = [*HARD, *((100 + i, f"http://h/{i}", "<p>same é" if i % 2 else f"<p>{i}") for i in range(40))]
    df = pages(spark, rows).repartition(3)
    manifest = warc.write_archives(df, fresh_path(spark, "w"), warc.train_dictionary(df), least, 2000, broadcast_rows)
    assert manifest.count() > 3
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(manifest).collect()), key=str)
    first, want = {}, []
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= least and first.get(p, i) != i
        want.append((i, "revisit" if again else "response", first[p] if again else None, len(p), warc.sha1_base32(p)))
    assert got == sorted(want, key=str)


# Rollups

CHANGE = "source string, lang string, tokenizer string, old_tokens long, new_tokens long, n_docs string"


def changes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CHANGE)


def test_batches_are_committed_once(spark):
    r = rollups.Rollup(spark, fresh_path(spark, "rollup"))
    assert r.totals().count() == 0
    first = changes(spark, [("a", "en", "v1", None, 5), ("a", "en", "v1", None, 7), (None, None, "v1", None, 1), ("b", "en", "v1", None, 2), ("b", "en", "v1", None, None)])
    assert r.commit("1", first) and not r.commit("1", first)
    assert r.commit("2", changes(spark, [("a", "en", "v1", 5, 6), ("b", "en", "v1", 2, None)]))
    assert r.commit("3", changes(spark, []))
    want = [("a", "en", "v1", 2, 13), (None, None, "v1", 1, 1)]
    assert sorted(map(tuple, r.totals().collect()), key=str) == sorted(want, key=str)
    r.compact()
    assert not r.commit("2", first)
    again = rollups.Rollup(spark, r.folder)
    assert sorted(map(tuple, again.totals().collect()), key=str) == sorted(want, key=str)
    assert again.commit("4", changes(spark, [("a", "en", "v1", 6, None)]))
    assert ("a", "en", "v1", 1, 7) in set(map(tuple, again.totals().collect()))
    with pytest.raises(ValueError):
        r.commit("../x", first)


def test_a_driver_that_dies_before_the_rename_loses_nothing(spark, monkeypatch):
    r, batch = rollups.Rollup(spark, fresh_path(spark, "rollup")), changes(spark, [("a", "en", "v1", None, 5)])
    with monkeypatch.context() as m:
        m.setattr(rollups.Rollup, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            r.commit("1", batch)
        with pytest.raises(ZeroDivisionError):
            r.compact()
    assert r.totals().count() == 0
    assert r.commit("1", batch) and not r.commit("1", batch)
    assert r.totals().first()["n_tokens"] == 5


def test_writers_at_once(spark, monkeypatch):
    """A second commit of an id, a batch during a compaction and a second compaction count once."""
    r, batch = rollups.Rollup(spark, fresh_path(spark, "rollup")), changes(spark, [("a", "en", "v1", None, 5)])
    publish, done = rollups.Rollup._publish, []

    def meanwhile(self, name, target):
        if not done:
            done.append(name)
            other = rollups.Rollup(spark, r.folder)
            if name.startswith("base"):
                assert other.commit("late", batch) and other.compact()
            else:
                assert other.commit("1", batch)
        return publish(self, name, target)

    monkeypatch.setattr(rollups.Rollup, "_publish", meanwhile)
    assert not r.commit("1", batch)
    done.clear()
    assert not r.compact()
    assert r.totals().first()["n_tokens"] == 10
    assert r.vacuum(-60) >= 2
    assert r.totals().first()["n_tokens"] == 10
    assert not r.commit("1", batch) and not r.commit("late", batch) and r.compact()
    assert r.totals().first()["n_tokens"] == 10


def test_repeated_texts(spark):
    """Null and repeated ids: all rows of a repeated text, and the first of each by doc_id."""
    rows = [(None, "t", "a", "en", 1)] * 3 + [(5, "t", "b", "en", 1), (5, "t", "b", "en", 1), (9, "t", "c", "fr", 1), (1, None, "a", None, 0), (2, "", "b", None, 0), (3, "x", "a", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    every, first = (sorted((tuple(r) for r in x.collect()), key=str) for x in rollups.repeats(df, "source", "lang"))
    assert every == sorted([(r[2], r[3]) for r in rows[:-1]], key=str)
    assert first == sorted([("b", "en"), ("a", None)], key=str)


def test_rollup_sql_and_tokenizer(spark, tmp_path):
    """The query against its SQL, and the tokenizer's totals against the tokenizer, with null and repeated ids."""
    import duckdb
    from tokenizers import Tokenizer

    from sparkloom.llm import packing

    rows = [(1, "b c", "s", "en", 3), (2, None, None, None, None), (3, "", "s", None, 0), (None, "It's naïve…", "s", "fr", 9), (None, "x", "s", "fr", 1), (7, "b c", "s", "en", 3), (7, "b c", "s", "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["source", "lang", "tokenizer", "n_docs", "n_tokens"]
    want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({rollups.OP4_SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in rollups.op4_token_rollups(spark, str(tmp_path)).select(*columns).collect()), key=str) == want
    tok, sums = Tokenizer.from_file(packing.default_tokenizer()), {}
    for _, t, source, lang, _ in rows:
        n = sums.setdefault((source, lang), [0, 0])
        n[0] += 1
        n[1] += len(tok.encode(t or "", add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in rollups.token_rollups_bpe(spark, str(tmp_path)).collect()}
    assert got == sums


# Pipeline


def test_pipeline_against_its_operators(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        seen.append(out.select("doc_id").distinct().count())
        docs = out
    assert seen[-1] == seen[-2] and sorted(seen, reverse=True) == seen
    done = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, docs.collect()))
