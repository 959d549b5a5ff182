"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier is trained in numpy from confirmed toxic texts (positives) and from texts
whose label is not used (unlabelled). With the class prior pi, the risk is

    pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)])

and where the second part falls below zero, the step goes up its gradient, which keeps a flexible
classifier from driving the corrected risk negative. pi is the share of toxic rows among all
documents; where `prior` does not give it, it is taken to be that among the training labels, as if
these had been drawn at random.

Features are presences, told by 32-bit hashes ("places"): every distinct word (runs of letters, lower-cased)
and its first 4 and 5 letters where it is longer, so that inflected and compound forms share
weight. Training keeps the places whose rate among the positives, less `sure` standard errors, is
`lift` times that among the unlabelled. Those hold positives as well, so 1 / pi is the largest lift there
is, and lift is at most its square root.

The sample is bounded by parameters: at most `positives` toxic and `unlabelled` other texts, drawn by
hash of the id over the whole table; every document is scored over its whole text in one narrow
pass with the broadcast weights. Held-out labels (crc32 of the id as text, modulo 3, is 1) are
never read by training; lang, source and doc_id are never features.

Edge cases: null and empty texts have no features and get the bias's score; a table without toxic
training labels scores everything 0; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, crc_of_id, scan, trim_memory

SCORES = "doc_id long, score double"
WORD = re.compile(r"[^\W\d_]+").findall


def places_of_word(w: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(x.encode()) for x in (w, *("^" + w[:k] for k in (4, 5) if len(w) > k)))


def places_of(text: str | None) -> np.ndarray:
    """Sorted distinct feature places of a text."""
    out = {p for w in set(WORD(text.lower())) for p in places_of_word(w)} if text else ()
    return np.fromiter(sorted(out), dtype=np.uint32, count=len(out))


class Model:
    """Sorted places, their weights and a bias."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        self.column, self.weights, self.bias = {int(p): i for i, p in enumerate(places)}, weights, bias
        self.words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        """The probability of label 1. The columns of words are kept, up to a number of words; most have none."""
        words, found = self.words, set()
        if len(words) > 200_000:
            words.clear()
        for w in set(WORD(text.lower())) if text else ():
            c = words.get(w)
            if c is None:
                c = words[w] = tuple(self.column[p] for p in places_of_word(w) if p in self.column)
            if c:
                found.update(c)
        return float(sigmoid(self.weights[sorted(found)].sum() + self.bias))


class Rows:
    """Sparse 0/1 rows over `dim` columns."""

    def __init__(self, rows: list[np.ndarray], dim: int):
        self.lengths, self.dim = np.array([len(r) for r in rows], dtype=np.int64), dim
        self.index = np.concatenate([*rows, np.zeros(0, np.int64)])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def __len__(self) -> int:
        return len(self.lengths)

    def logits(self, w: np.ndarray, bias: float) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(w[self.index])))
        return sums[self.starts[1:]] - sums[self.starts[:-1]] + bias

    def pull(self, g: np.ndarray) -> np.ndarray:
        """Gradient of the weights, given that of the logits."""
        return np.bincount(self.index, weights=np.repeat(g, self.lengths), minlength=self.dim)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, lift: float, sure: float) -> np.ndarray:
    """The places to learn from, sorted: the rate among the positives, less `sure` standard errors, is `lift` times the other.

    A place that only positives have reaches 1 / prior, one that tells nothing 1; `lift` is at most halfway in logarithms."""
    places, p = np.unique(np.concatenate([*positive, np.zeros(0, np.uint32)]), return_counts=True)
    every = np.concatenate([*unlabelled, np.zeros(0, np.uint32)])
    at = np.minimum(np.searchsorted(places, every), max(0, len(places) - 1))
    u = np.bincount(at[places[at] == every], minlength=len(places)) if len(places) else p
    lift = min(lift, prior**-0.5)
    return places[(p - sure * np.sqrt(p)) * max(1, len(unlabelled)) > lift * (u + 1) * len(positive)]


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, lift: float = 4.0, sure: float = 1.3, steps: int = 2500, rate: float = 0.05, decay: float = 1e-6, batch: int = 2000, seed: int = 5) -> Model:
    """The model that lowers the non-negative corrected risk; Adam on batches."""
    rng = np.random.default_rng(seed)
    places = telling(positive, unlabelled, prior, lift, sure)
    dim = len(places)

    def narrow(rows, part):
        at = [np.searchsorted(places, rows[i]) for i in part]
        return Rows([a[(a < dim) & (places[np.minimum(a, dim - 1)] == rows[i])] if dim else a[:0] for a, i in zip(at, part, strict=True)], dim)

    rows_p, rows_u = ([narrow(rows, part) for part in folds(len(rows), batch, rng)] for rows in (positive, unlabelled))
    w, bias, m, v = np.zeros(dim), float(np.log(prior / (1 - prior))), np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        p, u = rows_p[t % len(rows_p)], rows_u[t % len(rows_u)]
        sp, su = sigmoid(p.logits(w, bias)), sigmoid(u.logits(w, bias))
        # log loss: l(+) = -log s, l(-) = -log(1 - s)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        of_p, of_u = -prior * sp / len(p), su / len(u)
        if negative >= 0:
            gp, gu = of_p - prior * (1 - sp) / len(p), of_u
        else:
            gp, gu = -of_p, -of_u
        g = np.concatenate((p.pull(gp) + u.pull(gu) + decay * w, [gp.sum() + gu.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(places, w, float(bias))


def folds(n: int, batch: int, rng) -> list[np.ndarray]:
    return np.array_split(rng.permutation(n), max(1, -(-n // batch)))


def is_held_out(c: Column) -> Column:
    return F.coalesce(F.pmod(crc_of_id(c), F.lit(3)) == 1, F.lit(False))


def sketch_of(text: str, k: int = 8) -> list[int]:
    """The k smallest hashes of a text's 5-word windows; copies share most of them."""
    words = text.split()
    return sorted({zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))})[:k]


def first_of_copies(rows: list[tuple[int, np.ndarray, list[int]]]) -> list[np.ndarray]:
    """The features of (place, features, sketch) rows, without rows half of whose sketch was seen before."""
    out, seen = [], set()
    for _, places, sketch in rows:
        if 2 * sum(h in seen for h in sketch) <= len(sketch):
            out.append(places)
        seen.update(sketch)
    return out


def lowest(ids: DataFrame, n: int) -> DataFrame:
    """At most n ids, those with the smallest hash."""
    return ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def draw(docs: DataFrame, ids: DataFrame, n: int) -> list[np.ndarray]:
    """Features of at most n texts of the ids, those of the lowest hash, one of a group of copies; made on the executors.

    The ids, bounded by n, are broadcast, so that the texts are filtered where they are read."""
    ddl = "place long, places binary, sketch binary"

    def featurize(batches):
        for b in batches:
            places, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(texts), 200):
                yield arrow_batch(ddl, [(p, places_of(t).tobytes(), np.array(sketch_of(t), np.uint32).tobytes()) for p, t in zip(places[i : i + 200], texts[i : i + 200], strict=True)])
        trim_memory()

    picked = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.xxhash64("doc_id", "text").alias("place"), "text")
    rows = picked.mapInArrow(featurize, ddl).dropDuplicates(["place"]).orderBy("place").limit(n).toLocalIterator()
    return first_of_copies([(r[0], np.frombuffer(bytes(r[1]), np.uint32), np.frombuffer(bytes(r[2]), np.uint32).tolist()) for r in rows])


def fit(documents: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 12_000, prior: float | None = None, **params) -> Model | None:
    """The model from training labels and texts; None where no training label is toxic. prior: the toxic share of all documents."""
    keep = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id")))
    keep = keep.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = keep.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return None
    prior = min(max(n_toxic / n if prior is None else prior, 1e-4), 0.9)
    docs = scan(documents, "doc_id", "text").where("text is not null and doc_id is not null")
    p = draw(docs, lowest(keep.where("toxic = 1"), positives), positives)
    u = draw(docs, lowest(docs.where(~is_held_out(F.col("doc_id"))), unlabelled), unlabelled)
    if not p:
        return None
    return train_nnpu(p, u, prior, **params)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""
    docs = scan(documents, "doc_id", "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield arrow_batch(SCORES, [(doc_id, shared.value.score(text)) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        shared.value.words.clear()  # the worker lives on for other stages
        trim_memory()

    return docs.mapInArrow(run, SCORES)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    scored = score(documents, fit(documents, labels, **params))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted of every document; nulls, empty and long texts as stated above."""
    from .common import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
