"""The pipeline against a judgement of every row by itself: pairs of sets, windows of words, ids of a tokenizer."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import langid, packing, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", lowered(t))
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def kept_by_hand(spark, rows, labels, bench):
    """Rows that each stage leaves, judged one by one; the models are trained on what the stage before left."""
    frame = lambda x: spark.createDataFrame(x, DOC)
    left = [list(rows)]
    model = toxicity.fit(frame(rows), labels)
    left.append([r for r in left[-1] if model is None or model.score(r[1]) < 0.7])
    langs, net = langid.fit(frame(left[-1]))
    known = lambda t: net and t and any(c.isalpha() for c in t) and langid.pooled(net, [t], None).max() >= 0.4
    left.append([r for r in left[-1] if known(r[1])])
    now = left[-1]
    sets, up = [shingle_set(r[1]) for r in now], list(range(len(now)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(now)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(now):
        groups[find(i) if sets[i] else ("none", i)].append(r)
    left.append([groups[k] for k in groups])
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for _, t in bench:
        w = words(t)
        n = min(10, len(w))
        windows[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    clean = lambda t: not any(tuple(w[i : i + n]) in windows[n] for w in [words(t)] for n in windows for i in range(len(w) - n + 1))
    return left, clean


@pytest.mark.parametrize("kind", ["documents", "hard"])
def test_every_row_is_judged_as_by_hand(spark, tmp_path, kind):
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    labels, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("labels", "benchmark"))
    passages = [tuple(r) for r in bench.select("item_id", "text").collect()]
    rows = [tuple(r) for r in base]
    if kind == "hard":
        clean, toxic = (next(r[1] for r in base if r["doc_id"] in {x[0] for x in labels.where(f"toxic = {k}").select("doc_id").collect()} and len(r[1]) > 800) for k in (0, 1))
        for i in (None, 7, None, 7):
            rows += [(i, clean, "en", "s", 1), (i, toxic, "en", "s", 1), (i, "Own words here " + passages[3][1] + " and on", "en", "s", 1)]
        rows += [(None, None, "en", "s", None), (None, "", None, None, 0), (8, " 12 ²½ %", "en", "s", 3), (None, " \n", "en", "s", 2)]
        rows += [(5_000 + i, " ".join(["one", "and", "the", "same", "sentence", "here"] * 4000), "en", "s", 1) for i in range(2)]
        rows += [(None, "only null ids of this text with words enough", "en", "s", k) for k in range(3)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOC).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    left, clean = kept_by_hand(spark, rows, labels, passages)
    docs, got = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out-{name}")
        docs = spark.read.parquet(f"{d}/out-{name}")
        got.append([tuple(r) for r in docs.collect()])
    count = lambda rows: Counter((r[0], r[1]) for r in rows)
    assert count(got[0]) == count(left[1]) and count(got[1]) == count(left[2])
    assert len(left[1]) < len(left[0]) and len(left[3]) < len(left[2])
    order = lambda r: (r[0] is None, r[0] or 0)
    rest = count(got[2])
    assert sum(rest.values()) == len(left[3])
    for group in left[3]:
        least = min(map(order, group))
        assert sum(rest[r[0], r[1]] for r in {(x[0], x[1]): x for x in group if order(x) == least}.values()) >= 1
    assert count(got[3]) == count(r for r in got[2] if clean(r[1])) and len(got[3]) < len(got[2])
    from tokenizers import Tokenizer

    tok, sums = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for r in got[3]:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        sums[r[0], len(ids)] += len(ids)
    packed = Counter()
    for doc_id, _, length, _, doc_tokens, _, _ in got[4]:
        packed[doc_id, doc_tokens] += length
    assert packed == sums
    whole = {(r[0], r[4], r[3]) for r in got[4] if r[1] == 0 and r[2] == r[4]}
    assert whole <= {(r[0], len(ids), zlib.crc32(ids.tobytes())) for r in got[3] for ids in [np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")]}
    if kind == "documents":
        assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(got[4])


def test_empty_tables_and_extra_columns(spark, tmp_path):
    import corpus_pipeline

    extra = "doc_id long, text string, lang string, source string, n_chars long, score double, row_key long, gone_key string, root long, `a.b` string"
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "a few words of a text that nobody has seen before"
    for n, rows in enumerate(([], [(1, text, "en", "s", 1, 0.5, 1, "x", 2, "y"), (2, text, "en", "s", 1, 0.5, 1, "x", 2, "y"), (2, text, "en", "s", 1, 0.5, 1, "x", 2, "y")])):
        docs = spark.createDataFrame(rows, extra)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        assert [r["doc_id"] for r in docs.collect()] == [1] * n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == n
