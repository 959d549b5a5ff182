"""Quality rules with thresholds that adapt to each language and source, in DataFrame functions only.

Four rates of every text - mean word length, symbols per word, share of repeated lines, share of
words in repeated 3-word windows - are summarised by KLL quantile sketches per language and source.
Sketches merge, so the language's and the corpus's are merged from the groups' and serve groups
with too few rows. A rate's limits in a group come from its quantiles alone: the median and the quantile
of the rate's rank in TAILS (the share of texts taken to be sound on that side) give a spread, and the
limit lies `width` spreads beyond that quantile. Word length has a lower limit too, from the mirrored
rank. Where nine texts of ten have no symbol, say, the limit is none: it follows the group even there,
and no cutoff is written down. The limits are joined back and a text is kept if every rate lies within
them. The fixed base rule (too short, mostly repetition) stays
apart: its failures neither feed the sketches nor pass.

The sketches are combined before the shuffle and are of bounded size, so one source with a third
of all rows is one small buffer per task. The limits have a row per language and source; Spark's
size-checked broadcast or a shuffle joins them (a hot group is then split as a skewed join).

KLL compaction draws random bits, so limits may move within the sketch's rank error (under 1 % at
k = 400) between runs; groups of fewer rows than k are exact.

Edge cases: null and empty texts have no words and fail the base rule; null languages or sources
form groups of their own; repeated rows count and come back once each; a corpus without any text
that passes the base rule keeps nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialise

SYMBOLS = "#*$%&|<>"
#: Rate: the rank of its outer quantile. Lines and windows repeat in few sound texts, whose tail lies further out.
TAILS = {"word_length": 0.9, "symbol_rate": 0.9, "line_repeat": 0.98, "window_repeat": 0.98}
#: The rates with a lower limit as well.
TWO_SIDED = ("word_length",)


def measures(documents: DataFrame) -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Texts without a repeated 3-word window, found by one hash set, skip the sorting that locates
    them. Windows are compared by 64-bit hash within a text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(t, F.lit(BLANKS))
    df = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        "source",
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "").alias("lines"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")).alias("words"),
    )
    df = df.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
            F.lit(1),
            F.greatest(F.size("words") - 2, F.lit(0)),
        ).alias("windows"),
    )
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, k: F.coalesce(F.get("placed", k)["h"] == e["h"], F.lit(False))
    again = F.filter("placed", lambda e, k: same(e, k + 1) | same(e, k - 1))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return df.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("placed").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / n,
        "line_repeat": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "window_repeat": F.col("n_repeat_words") / n,
    }


def limits(measured: DataFrame, width: float = 3.0, k: int = 400, min_rows: int = 100, tails: dict[str, float] | None = None) -> DataFrame:
    """lang, source and low_/high_ of every rate, from merged sketches of the texts that pass the base rule."""
    tails = tails or TAILS
    passed = measured.where(~base_failed()).select("lang", "source", *(c.alias(n) for n, c in rates().items()))
    groups = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(n, F.lit(k)).alias(n) for n in tails))
    groups = materialise(groups, "quality-sketches")
    if groups.isEmpty():
        return groups.select("lang", "source", *(F.lit(None).cast("double").alias(f"{side}_{n}") for n in tails for side in ("low", "high")))
    merged = lambda *by: groups.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(n, F.lit(k)).alias(n) for n in tails))
    ranks = lambda name: (1 - tails[name], 0.5, tails[name])
    quantiles = lambda name, sketch: [F.kll_sketch_get_quantile_double(sketch, F.lit(round(q, 6))) for q in ranks(name)]
    every = merged().select(*(c.alias(f"{name}{i}") for name in tails for i, c in enumerate(quantiles(name, F.col(name))))).first()
    out = groups.alias("g").join(merged("lang").alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")))
    columns = []
    for name in tails:
        own, wide = quantiles(name, F.col(f"g.{name}")), quantiles(name, F.col(f"l.{name}"))
        low, middle, high = (F.when(F.col("g.n") >= min_rows, own[i]).when(F.col("l.n") >= min_rows, wide[i]).otherwise(F.lit(every[f"{name}{i}"]).cast("double")) for i in range(3))
        least = low - width * (middle - low) if name in TWO_SIDED else F.lit(0.0)
        columns += [least.alias(f"low_{name}"), (high + width * (high - middle)).alias(f"high_{name}")]
    return out.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *columns)


def judge(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """measured with base_failed and kept. A group without limits has no text that passes the base rule."""
    b = bounds.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    within = F.lit(True)
    for name, c in rates().items():
        within = within & c.between(F.col(f"low_{name}"), F.col(f"high_{name}"))
    joined = measured.join(b, F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source")), "left")
    return joined.select(measured["*"], base_failed().alias("base_failed"), F.when(base_failed(), F.lit(False)).otherwise(F.coalesce(within, F.lit(False))).alias("kept"))


def filter_quality(documents: DataFrame, **params) -> DataFrame:
    """Per document row: the measures, base_failed and kept. Texts are read and measured once."""
    measured = materialise(measures(documents), "quality-measures")
    return judge(measured, limits(measured, **params))


def op6_quality(spark, sf_dir):
    """The measures, base_failed and kept of every document; nulls, empty texts and ties as stated above."""
    from .common import table

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return filter_quality(table(spark, sf_dir, "documents")).select(*columns)
