"""Trained operators: gradients against differences, held-out accuracy, hard rows."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import brown, langid, toxicity

DOC = "doc_id long, text string, lang string, source string, score double, held_out boolean"
HARD = [(1, None, "en"), (2, "", "de"), (3, " \n 12 %%", None), (4, "x", "en"), (4, "x", "en"), (None, "hello there", "en"), (5, "word " * 20_000, "en")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 9.0, True) for i, t, lang in rows], DOC)


def made(n, seed=0):
    """Texts of two languages by syllables."""
    rng, out = np.random.default_rng(seed), []
    kinds = {"en": ["the", "and", "tion", "wh", "ing", "ou"], "fr": ["é", "eau", "les", "què", "oi", "ç"]}
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        out.append((i, " ".join("".join(rng.choice(kinds[lang], int(rng.integers(1, 4)))) for _ in range(int(rng.integers(5, 60)))), lang))
    return out


# Language identification


def test_gru_gradients():
    rng = np.random.default_rng(0)
    net = langid.BiGRU(3, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 5, (6, 4)).astype(np.int16), np.array([0, 1, 2, 1])
    x[5, 0] = 256
    _, g = net.gradients(x, y)
    for k, a in net.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, 5 if k[0] == "W" and i == 0 else n)) for i, n in enumerate(a.shape))
            old = a[at]
            a[at] = old + 1e-3
            up, _ = net.gradients(x, y)
            a[at] = old - 1e-3
            down, _ = net.gradients(x, y)
            a[at] = old
            assert (up - down) / 2e-3 == pytest.approx(g[k][at], abs=2e-4)


def test_fast_inference_equals_the_plain_one():
    rng = np.random.default_rng(1)
    net, x = langid.BiGRU(8, 4), rng.integers(0, 256, (48, 20)).astype(np.int16)
    x[30:, 3] = 256
    counts = (x < 256).astype(np.float32)
    counts[:9, 5] = 0
    logits = np.concatenate((net.direction("f", x), net.direction("b", x)), axis=2) @ net.p["V"] + net.p["c"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p = p / p.sum(axis=2, keepdims=True) * counts[..., None]
    assert np.abs(p.sum(axis=0).T - net.segment_sums(x, counts)).max() < 1e-4


def test_segments_give_the_unbroken_network(monkeypatch):
    """Probabilities of long texts, with segments that end within characters, against one run over all bytes."""
    texts = [t for _, t, _ in made(40, 2)]
    x = np.concatenate([langid.stretches(t, 6) for t in texts])
    y = np.repeat([i % 2 for i in range(40)], [len(langid.stretches(t, 6)) for t in texts])
    net = langid.train(x, y, 2, steps=80)
    long = [" ".join(texts[:12]), texts[1], "é", " ".join(texts[1::2]) + " the end", "é " * 700]
    whole = langid.pooled(net, long, None)
    for i, t in enumerate(long):
        raw = langid.raw_of(t).astype(np.int16)[:, None]
        logits = np.concatenate((net.direction("f", raw), net.direction("b", raw)), axis=2) @ net.p["V"] + net.p["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        assert (p / p.sum(axis=2, keepdims=True)).mean(axis=(0, 1)) == pytest.approx(whole[i], abs=1e-4)
    monkeypatch.setattr(langid, "CELLS", 3000)
    assert np.abs(langid.pooled(net, long) - whole).max() < 1e-5
    assert np.abs(langid.pooled(net, long[1:], 300, 100) - whole[1:]).max() < 0.005


def test_letters_are_unicode_letters(spark):
    assert [langid.has_letter(x) for x in ("²½① 12_", "ⅷ", "x", "…é", "中")] == [False, False, True, True, True]
    assert (np.diff(langid.stretches("é" * 500, 5)[:, :2]) < 0).all()


def test_language_accuracy_and_hard_rows(spark):
    rows = [(i + 100, t, lang) for i, t, lang in made(240)]
    got = langid.identify(docs(spark, rows + HARD), steps=150).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len(got) == len(rows) + len(HARD)
    none = langid.identify(docs(spark, [(1, "abc", None)])).collect()
    assert (none[0]["lang_pred"], none[0]["score"]) == ("und", 0.0)
    assert langid.identify(docs(spark, [])).count() == 0


# Toxicity


def toxic_rows(n=600):
    rows, labels = [], []
    for i, t, lang in made(n, 3):
        bad = i % 9 == 0
        rows.append((i, t + (" idiot moron trash" if bad else ""), lang))
        if i % 2 == 0 or bad:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    got = toxicity.toxicity(docs(spark, rows + [(None if i is None else i + 9000, t, x) for i, t, x in HARD]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["predicted"] == truth[r["doc_id"]] for r in held} == {True}
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len(got) == len(rows) + len(HARD)


def test_toxicity_without_toxic_labels(spark):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs(spark, HARD), labels).collect()} == {0.0}
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0


def test_held_out_labels_are_not_read(spark):
    rows, labels = toxic_rows(300)
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (sorted(toxicity.toxicity(docs(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", "score").collect()) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
def test_toxic_words_are_learnt_at_any_share(share):
    rng = np.random.default_rng(7)
    plain, toxic = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)], [f"{chr(97 + i)}bad" for i in range(10)]

    def text(bad):
        return " ".join([*rng.choice(plain, 20), *(rng.choice(toxic, 2) if bad else ())])

    positive = [toxicity.places_of(text(True)) for _ in range(1000)]
    unlabelled = [toxicity.places_of(text(i < share * 4000)) for i in range(4000)]
    kept = set(toxicity.telling(positive, unlabelled, share, 4.0, 1.3).tolist())
    assert sum(toxicity.places_of_word(w)[0] in kept for w in toxic) >= 9
    assert sum(toxicity.places_of_word(w)[0] in kept for w in plain) <= 6
    model = toxicity.train_nnpu(positive, unlabelled, share, steps=600)
    scores = {bad: np.array([model.score(text(bad)) for _ in range(200)]) for bad in (True, False)}
    assert (scores[True] >= 0.7).mean() > 0.95 and (scores[False] >= 0.7).mean() < 0.05


def test_samples_of_repeated_ids_are_the_same_each_time(spark):
    """Many texts share an id: the bound takes those of the lowest hash, whatever the partitions."""
    df = docs(spark, [(i % 3, f"w{i} a b c d e f {i * 7}", "en") for i in range(300)] + [(1, "same x y", "en")] * 50)
    ids = df.select("doc_id").distinct()
    a, b = ([x.tolist() for x in toxicity.draw(d, ids, 40)] for d in (df.repartition(2), df.repartition(5)))
    assert a == b and 0 < len(a) <= 40


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5])
def test_held_out_recall_at_other_shares(spark, share):
    """Every label given, a share of them toxic: nearly all held-out toxic rows are found and no other."""
    rng = np.random.default_rng(11)
    rows = [(i, t + (" " + " ".join(rng.choice(["idiot", "moron", "trash", "scum"], 3)) if rng.random() < share else ""), lang) for i, t, lang in made(900, 5)]
    labels = [(i, int(bool(re.search("idiot|moron|trash|scum", t)))) for i, t, _ in rows]
    got = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"]]
    assert np.mean([p for y, p in held if y]) > 0.9 and np.mean([p for y, p in held if not y]) < 0.03


def test_copies_are_learnt_from_once():
    t = toxicity.sketch_of("a b c d e f g h i j k l m n o p")
    rows = [(0, np.array([1]), t), (1, np.array([1]), t), (2, np.array([2]), toxicity.sketch_of("q r s t u v"))]
    assert [list(x) for x in toxicity.first_of_copies(rows)] == [[1], [2]]


# Class bigrams


def likelihood(n, cls, classes):
    t = np.zeros((classes, classes))
    for (i, j), k in np.ndenumerate(n):
        t[cls[i], cls[j]] += k
    return brown.xlogx(t).sum() - brown.xlogx(t.sum(0)).sum() - brown.xlogx(t.sum(1)).sum()


def test_exchange_ends_where_no_move_raises_the_likelihood():
    n = np.random.default_rng(0).integers(0, 6, (13, 13)).astype(float)
    r, c = np.nonzero(n)
    values = []
    for sweeps in range(6):
        cls = brown.exchange(r, c, n[r, c], 13, 3, 12, sweeps=sweeps)
        values.append(likelihood(n, cls, 4))
    assert values == sorted(values) and values[-1] > values[0] and cls[12] == 3
    for u in range(12):
        for k in range(3):
            moved = cls.copy()
            moved[u] = k
            assert likelihood(n, moved, 4) <= values[-1] + 1e-9


@pytest.mark.filterwarnings("error")
def test_exchange_settles_on_word_bigrams():
    """The likelihood rises in every sweep until nothing moves, with words that follow themselves and open texts."""
    c = brown.Classes({w: i for i, w in enumerate([b"the", b"and", b"les", b"oi", b"ing", b"ou", b"eau"])}, list(range(7)), list(range(7, 15)))
    pairs = collections.Counter()
    for _, t, _ in made(120):
        ids = [15, *c.of(brown.words_of(t))[0].tolist(), 15]
        pairs.update(zip(ids, ids[1:], strict=False))
    n = np.zeros((16, 16))
    for k, v in pairs.items():
        n[k] = v
    r, c = np.nonzero(n)
    values = [likelihood(n, brown.exchange(r, c, n[r, c], 16, 4, 15, sweeps=k), 5) for k in range(1, 9)]
    last = likelihood(n, brown.exchange(r, c, n[r, c], 16, 4, 15), 5)
    assert values == sorted(values) and last >= values[-1]


def test_base_scores_and_counts(spark):
    rows = [(i + 100, t, lang) for i, t, lang in made(200)] + HARD
    got = brown.class_bigram_scores(docs(spark, rows), classes=6, head_units=40, pools=10, head_words=60).collect()
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t, _ in rows if not held(i) for w in split(t))
    total, types = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (types + 1))) for w in split(t)), 4)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert brown.class_bigram_scores(docs(spark, [])).count() == 0


def test_probabilities_of_the_next_word_sum_to_one(spark):
    rows = made(120)
    model, tail, *_ = brown.train(docs(spark, rows), F.lit(False), classes=4, head_units=20, pools=5, head_words=60)
    tail = [(bytes(r["word"]), r["c"], r["k"]) for r in tail.collect()]
    c = collections.Counter(w for _, t, _ in rows for w in brown.words_of(t))
    assert {w: n for w, n, _ in tail} == {w: n for w, n in c.items() if w not in model.classes.rank} and len(model.classes.rank) > 20
    assert all(k == model.classes.pool(w) for w, n, k in tail if n < 3)
    k = np.array([*model.classes.of_rank.tolist(), *(x for *_, x in tail)])
    emission = np.array([*model.head.tolist(), *(math.log10(n + 0.1) for _, n, _ in tail)]) - model.emissions[k]
    sums = np.bincount(k, 10**emission, 5)
    unseen = 0.1 / 10 ** model.emissions[:4]
    assert (sums[:4] + unseen)[np.isin(np.arange(4), k)] == pytest.approx(1)
    assert (10**model.transitions).sum(axis=1) == pytest.approx(np.ones(5))


def test_scores_against_brute_force(spark):
    """Score of every row from the model's classes, by sums over its words; words without a rank come by the join."""
    rows = [(i + 100, t, lang) for i, t, lang in made(150)] + HARD
    df, params = docs(spark, rows), {"classes": 6, "head_units": 15, "pools": 7, "head_words": 40}
    got = collections.Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in brown.class_bigram_scores(df, **params).collect())
    model, tail, *_ = brown.train(df, brown.is_held_out(df["doc_id"]), **params)
    tail = {bytes(r["word"]): (r["c"], r["k"]) for r in tail.collect()}
    own = {w: (round(10 ** model.head[i] - 0.1), int(model.classes.of_rank[i])) for w, i in model.classes.rank.items()}
    want = collections.Counter()
    for i, t, _ in rows:
        words, before, total = brown.words_of(t), 6, 0.0
        for w in words:
            c, k = own.get(w) or tail.get(w) or (0, model.classes.pool(w))
            total += model.transitions[before, k] + math.log10(c + 0.1) - model.emissions[k]
            before = own[w][1] if w in own else model.classes.pool(w)
        want[i, len(words) + 1, round(total + model.transitions[before, 6], 6)] += 1
    assert got == want
    assert len(tail) > 20 and len({k for w, (c, k) in tail.items() if c >= 3}) > 1


def test_words_of_arrays_are_those_of_texts():
    """Blanks of ASCII alone split words; other white space and control characters are parts of them."""
    import pyarrow as pa

    texts = [None, "", " ", "A", " a\tB\n\x0bc\x0c\rd ", "x\x1cy\x1fz\x00", "É\xa0é\u2003\x85 Ä", "  two  Words", "İ ẞ K", "\r\n"]
    for part in (texts, texts[3:5], texts[5:7], texts[:1], []):
        got = brown.split(pa.array([None, *part, "rest of it"], pa.string())[1 : 1 + len(part)]).to_pylist()
        assert [[w.encode() for w in x or []] for x in got] == [brown.words_of(t) for t in part]


def test_scores_do_not_depend_on_batches(spark, monkeypatch):
    """Many blocks, buckets, pieces and Arrow batches give what few do."""
    own = [(i, f"unseen Word{i % 7} the " * 30, "en") for i in range(1000, 1300) if zlib.crc32(str(i).encode()) % 10 == 0]  # frequent in held-out texts only
    df, params = docs(spark, [(i + 100, t, lang) for i, t, lang in made(150)] + HARD + own), {"classes": 6, "head_units": 15, "pools": 7, "head_words": 40}
    columns = lambda: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in brown.class_bigram_scores(df, **params).collect())
    want = columns()
    monkeypatch.setattr(brown, "BUCKET", 200)
    monkeypatch.setattr(brown.word_counts, "__defaults__", (100,))
    monkeypatch.setattr(brown.pair_sums, "__defaults__", (50,))
    monkeypatch.setattr(brown.tail_contexts, "__defaults__", (100,))
    monkeypatch.setattr(brown.tail_classes, "__defaults__", (100,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert columns() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sums_of_long_runs_do_not_drift():
    sizes = np.array([0, 2, 0, 3_000_000, 1, 0])
    got = brown.sums_of_runs(np.concatenate((np.full(2, 0.5), np.full(3_000_000, 0.1), [7.0])), sizes)
    assert got == pytest.approx([0, 1, 0, 300_000, 7, 0], rel=1e-14)
    assert brown.sums_of_runs(np.zeros(0), np.zeros(2, np.int64)).tolist() == [0, 0]


def test_tasks_send_arrays_not_a_row_for_each_sum(spark):
    """Of all shuffles only that of the word counts may have a row for each word and task; op2 paid most for these rows."""
    rng = np.random.default_rng(4)
    vocabulary = ["w" + np.base_repr(i, 36) for i in range(3000)]
    texts = [" ".join(vocabulary[int(3000 * x**2)] for x in rng.random(100)) for _ in range(400)]
    df = docs(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(4).cache()
    df.count()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in store_stages(spark)}
    before = stages()
    assert brown.class_bigram_scores(df, classes=6, head_units=50, pools=20, head_words=500).count() == 400
    sent = [n for k, n in stages().items() if k not in before]
    words = 4 * len(vocabulary)
    assert 0 < max(sent) <= words and sum(sent) - max(sent) < 0.5 * words, sorted(sent)


def store_stages(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    found = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def test_words_move_to_the_class_of_greatest_gain():
    """Counts of a word moved between classes: the first-order gain picks the class that the exact likelihood does."""
    rng = np.random.default_rng(2)
    table = rng.integers(200, 4000, (6, 6)).astype(float)
    hits = 0
    for _ in range(60):
        left, right = rng.multinomial(8, rng.dirichlet(np.ones(6) / 3)), rng.multinomial(8, rng.dirichlet(np.ones(6) / 3))

        def value(b, left=left, right=right):
            t = table.copy()
            t[:, b] += left
            t[b] += right
            return brown.xlogx(t).sum() - brown.xlogx(t.sum(0)).sum() - brown.xlogx(t.sum(1)).sum()

        hits += brown.Gains(table).best(left[None], right[None])[0] == max(range(5), key=value)
    assert hits >= 58
