"""Decontamination, quality rules, Jaccard join and packing against brute force, with hard cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import components, decontamination, jaccard, packing, quality

DOC = "doc_id long, text string, lang string, source string, n_chars long, bucket string, g long, words string"


def docs(spark, texts):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "y") for i, t in texts], DOC)


LONG = " ".join(f"w{i % 997}" for i in range(30_000))
HARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, LONG), (7, "Éé ñ_x 1,2\x00 z"), (8, "A B c D E F")]


# Decontamination


def hit_words(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = split(text), set(), set()
    for item_id, t in items:
        b = split(t)
        k = min(n, len(b))
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add(item_id)
    return len(w), len(hit), sorted(x for x in ids if x is not None)


ITEMS = [(10, "the quick brown fox jumps over the lazy dog again and again"), (9, "b c d"), (11, None), (12, ""), (None, "w1 w2 w3"), (13, "é x"), (9, "b c d")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_contamination_against_brute_force(spark, block_bytes):
    texts = [*HARD, (20, "so THE quick, brown fox jumps over the lazy dog again and again! b c d"), (21, "the quick brown fox jumps over the lazy cat again"), (22, "é x w1 w2 w3 w4")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.contamination(docs(spark, texts), bench, block_bytes=block_bytes)
    want = []
    for i, t in texts:
        n, h, ids = hit_words(t, [(None if a is None else str(a), b) for a, b in ITEMS])
        want.append((i, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_an_index_is_bounded_by_its_text():
    text = " ".join(f"word{i % 4001}" for i in range(50_000))
    index = decontamination.WindowIndex([("a", text), ("b", "x y"), ("c", None)], 10)
    assert index.nbytes < 6 * len(text)
    assert decontamination.WindowIndex([("a", "a " * 50_000)], 10).nbytes < 20 * 100_000
    mask, items = index.find(decontamination.normalised("X, y! word1 word2"))
    assert (mask.tolist(), items) == ([True, True, False, False], {"b"})


def test_sql_of_decontamination(spark, tmp_path):
    import duckdb

    texts = [*HARD[:5], (20, "so THE quick, brown fox jumps over the lazy dog again and again! b c d"), (22, "é x w1 w2 w3 w4")]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([i for i in ITEMS if i[0] is not None], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(decontamination.OP10_SQL).fetchall()
    got = decontamination.op10_decontamination(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spans_are_removed(spark):
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontamination.remove_spans(docs(spark, [(1, "A, b c; D e"), (2, "x"), (3, None)]), bench).collect()}
    assert out == {1: ("A,  e", 5), 2: ("x", 1), 3: (None, None)}


def test_empty_tables(spark):
    none, bench = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs(spark, HARD), bench).where("contaminated").count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert quality.filter_quality(none).count() == 0
    assert packing.pack(none, packing.default_tokenizer()).count() == 0


# Quality


def measured(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    t = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for j in range(len(w) - 2) if t[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)


def test_quality_measures_against_brute_force(spark):
    texts = [*HARD, (20, "a b c a b c\nx\nx\n\n \nx"), (21, "a a a a a"), (22, "# $5 <b> a|b c"), (23, "l1\nl1\r\nl1")]
    got = quality.filter_quality(docs(spark, texts))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == sorted([(i, *measured(t)) for i, t in texts], key=str)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_thresholds_follow_the_group(spark):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    plain = [(i, " ".join(word(int(rng.integers(3, 7))) for _ in range(80)), "en", "a") for i in range(150)]
    long = [(1000 + i, " ".join(word(int(rng.integers(10, 14))) for _ in range(80)), "de", "b") for i in range(150)]
    odd = [(5000, " ".join(word(12) for _ in range(80)), "en", "a"), (5001, " ".join(word(5) + "%%" for _ in range(80)), "en", "a"), (5002, plain[0][1], None, None)]
    df = spark.createDataFrame([*plain, *long, *odd], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.filter_quality(df).collect()}
    assert all(kept[i] for i, *_ in [*plain, *long])
    assert (kept[5000], kept[5001], kept[5002]) == (False, False, True)


def test_kept_against_exact_quantiles(spark):
    """Groups of fewer rows than k have exact sketches: limits by sorting, group by group, with small groups merged."""
    rng, rows = np.random.default_rng(8), []
    for lang, source, n, size in (("en", "a", 160, 4), ("en", "b", 120, 6), ("en", "c", 9, 5), ("de", "a", 30, 9), (None, "a", 5, 4)):
        for _ in range(n):
            words = ["".join(rng.choice(list("abcdef"), max(1, int(rng.normal(size, 1.5))))) for _ in range(60)]
            if rng.random() < 0.2:
                words += ["x#", "$"] * int(rng.integers(1, 4))
            if rng.random() < 0.15:
                words += words[:3] * int(rng.integers(1, 12))
            text = " ".join(words) + "\nsame line\n" * int(rng.integers(0, size) * (rng.random() < 0.2))
            rows.append((len(rows), text + (" longer" + "y" * 300 if rng.random() < 0.05 else ""), lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    at, of_group, of_lang, every = {}, collections.defaultdict(list), collections.defaultdict(list), []
    for i, text, lang, source in rows:
        n, chars, symbols, dup, repeat = measured(text)
        lines = sum(bool(x.strip()) for x in text.split("\n"))
        at[i] = (n < 50 or 100 * repeat > 50 * n, (chars / n, symbols / n, dup / lines, repeat / n))
        if not at[i][0]:
            for part in (of_group[lang, source], of_lang[lang], every):
                part.append(at[i][1])

    def quantile(values, q):
        return sorted(values)[max(0, math.ceil(round(q * len(values), 6)) - 1)]

    want, used = {}, set()
    for i, _, lang, source in rows:
        failed, own = at[i]
        part = next((p for p in (of_group[lang, source], of_lang[lang]) if len(p) >= 100), every)
        ok = not failed
        for k, (name, q) in enumerate(quality.TAILS.items()):
            low, middle, high = (quantile([v[k] for v in part], x) for x in (1 - q, 0.5, q))
            least = low - 3 * (middle - low) if name == "word_length" else 0
            used.add((lang, source, name, high + 3 * (high - middle)))
            ok = ok and least <= own[k] <= high + 3 * (high - middle)
        want[i] = ok
    got = {r["doc_id"]: r["kept"] for r in quality.filter_quality(df).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert all(len({h for *_, name, h in used if name == n}) > 1 for n in quality.TAILS)


# Jaccard join


def classes(texts, n=5, percent=75):
    sets = []
    for _, x in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(texts)), key=str)


def corpus(seed):
    """Groups of near copies at every distance around the limit, with passages shared by many texts."""
    rng = np.random.default_rng(seed)
    word = lambda: f"v{int(rng.integers(0, 4000))}"
    passage = [word() for _ in range(60)]
    out, n = [], 0
    for size in (2, 3, 5, 8, 90):
        base = [word() for _ in range(int(rng.integers(30, 160)))] + (passage if size % 2 else [])
        for _ in range(size):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 14))):
                k = int(rng.integers(0, len(t)))
                op = rng.integers(0, 3)
                t[k : k + 1] = [word()] if op == 0 else [] if op == 1 else [t[k], word()]
            out.append((n, " ".join(t)))
            n += 1
    for _ in range(40):
        out.append((n, " ".join([word() for _ in range(int(rng.integers(1, 40)))] + passage)))
        n += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("params", [{}, {"rare": 2, "rounds": 0}, {"hot_sets": 8, "hot_one_in": 2, "rare": 2}])
def test_components_against_brute_force(spark, seed, params):
    texts = corpus(seed) + [(None if i is None else i + 10_000, t) for i, t in HARD]
    got = jaccard.near_duplicates(docs(spark, texts), block_tokens=2000, **params)
    assert sorted(map(tuple, got.collect()), key=str) == classes(texts)


@pytest.mark.parametrize(("count", "length"), [(1, 8), (5, 8), (50, 12), (20, 12), (0, 0)])
def test_small_tables_of_unrelated_texts(spark, count, length):
    """With default parameters: no token is shared at all, or by one linked pair only."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(length))) for i in range(count)]
    if count == 20:
        texts.append((99, texts[3][1] + " more"))
    assert sorted(map(tuple, jaccard.near_duplicates(docs(spark, texts)).collect()), key=str) == classes(texts)


@pytest.mark.parametrize("percent", [50, 60, 90, 100])
def test_other_similarities(spark, percent):
    rng = np.random.default_rng(percent)
    texts = [(i, " ".join(rng.choice(list("abcd"), int(rng.integers(1, 6))))) for i in range(60)] + corpus(4)[:60]
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    got = jaccard.near_duplicates(docs(spark, texts), n=2, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == classes(texts, 2, percent)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 777}" for i in range(5000)) + " " + "z" * 3000 + " tail"
    want = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "_PART", 1000)
    monkeypatch.setattr(jaccard, "_POWERS", [])
    assert (jaccard.word_hashes(text) == want).all() and len(jaccard._POWERS[0]) == 1001


def test_signatures_meet_for_every_linked_pair():
    """Of two sets at the limit, one signature is common whatever the frequencies are."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(3, 120))
        universe = np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
        df = {int(t): int(rng.choice([1, 2, 3, 50, 900])) for t in universe}
        x = rng.choice(universe, n, replace=False)
        drop = int(rng.integers(0, n // 7 + 1))
        y = np.concatenate((x[drop:], rng.choice(np.setdiff1d(universe, x), int(rng.integers(0, n // 8 + 1)), replace=False)))
        common = len(np.intersect1d(x, y))
        if 100 * common < 75 * (len(x) + len(y) - common) or len(x) == common == len(y):
            continue
        for t in np.intersect1d(x, y).tolist():
            df[t] = max(df[t], 2)

        def sigs(s, df=df):
            t = np.array([v for v in s.tolist() if df[v] > 1], np.uint64)
            f = np.array([df[v] for v in t.tolist()])
            order = np.lexsort((t, f))
            return jaccard.signatures(len(s), t[order], f[order], 75, 24)

        a, b = sigs(x), sigs(y)
        assert a is not None and b is not None and len(np.intersect1d(a, b)), (n, common)


@given(st.text(alphabet="aB \t\n\x0bé\U0001f600_,", max_size=60))
@settings(max_examples=150, deadline=None)
def test_word_hashes_follow_words(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = jaccard.word_hashes(text).tolist()
    assert len(h) == len(words)
    assert len(set(h)) == len(set(words))
    assert [jaccard.word_hashes(w)[0] for w in words] == h


def test_components_of_links(spark):
    links = [(1, 2), (2, 3), (7, 8), (9, 9), *((100, i) for i in range(101, 160)), *((i, i + 1) for i in range(200, 240))]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 241), 200)}


# Packing


def test_level_is_the_one_of_least_squares():
    rng = np.random.default_rng(5)
    p = packing.Packer(64)
    for _ in range(600):
        s = int(rng.integers(1, 64))
        best = None
        for h in range(64 - s + 1):
            if h and not p.levels[h]:
                continue
            n = p.levels.copy()
            n[h] -= h > 0
            n[h + s] += h + s < 64
            value = (int((n[1:64] ** 2).sum()), -h)
            best = min(best or value, value)
        assert p.choose(s) == -best[1]
        p.add(0, np.arange(s, dtype="<u4"))


def test_every_id_is_packed_once(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    texts = [*HARD, (30, "It's <|endoftext|> we'll İstanbul ΣΑΣ naïve… é don't\x1cx"), (31, "Thea thea, THEA. 12 %%% a|b")]
    rows = packing.pack(docs(spark, texts), path, size=256).collect()
    ids = collections.defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    pieces = collections.defaultdict(list)
    for r in rows:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0


class Counted(dict):
    looked_up = 0

    def get(self, *key):
        self.looked_up += 1
        return super().get(*key)


def test_python_sees_each_word_of_a_slice_once():
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        tok = packing.ChunkTokenizer(f.read())
    tok.cache = Counted(tok.cache)
    texts = [" ".join(["Word", "word,", "WORD.", "café", "CAFÉ!", "x1"] * 2000)] * 3
    assert len({ids.tobytes() for ids in tok.encode(pa.array(texts))}) == 1
    assert 0 < tok.cache.looked_up < 20


PARTS = ["Word", "WORD", "word", "Élan", "é", "J\u030c", "j", "\u030c", "\u0301", "İ", "ΣΑΣ", "ς", "ß", "×", "÷", "µ", "語", "'s", "DON'T", "12", "_", "…", "😀", *packing.ChunkTokenizer.MARKS]
PARTS += ["<|endoftext|>", "<|ENDOFTEXT|>", " ", " ", " ", "\n", "\r", "\t", "\x00", "\u00a0", "\u3000"]


@given(st.lists(st.none() | st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=12), st.sampled_from([1, 40, 1 << 20]), st.sampled_from([3, 1000]), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_chunks_encode_as_their_text(texts, slice_bytes, words, skip):
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        tok = packing.ChunkTokenizer.load(f.read())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "_BYTES_AT_ONCE", slice_bytes)
        m.setattr(packing, "_CACHE_WORDS", words)
        m.setattr(packing, "_KEPT_WORDS", words // 2)
        m.setattr(packing, "_WORDS_AT_ONCE", 2)
        for kind in (pa.string(), pa.large_string()):
            got = [ids.tolist() for ids in tok.encode(pa.array(texts, kind)[skip:])]
            assert got == [tok.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[skip:]]
