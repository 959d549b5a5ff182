"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training text.

The benchmark is turned into an index of word windows on the driver, block by block, each block under
a bound of text bytes that is checked before anything is collected, and which bounds the index; a larger
benchmark becomes more blocks, each scanned against all documents and released before the next is made.
Only documents with hits come out of such a scan; they are joined to all rows at the end. Documents are
never shuffled for one block: the scan is one narrow pass that reads doc_id and text only.

Words are runs of letters a-z, digits and non-ASCII characters after lower-casing A-Z. A window is
`n` consecutive item words; an item of fewer words, but at least one, is one window.

Edge cases: null or empty texts have no words and no hits; benchmark rows with null text are no
windows; a null item_id still marks hits but is not listed; repeated document rows are each scanned
and returned; repeated items count once by item_id; empty tables give an empty result or no hits.
Other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, materialise, scan, trim_memory
from .jaccard import hashes_of_bytes

#: bytes.translate table: A-Z lower-cased, ASCII other than letters and digits turned into blanks.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())

HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "doc_id long, text_hash long, items array<string>, starts array<int>, ends array<int>"


def normalised(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").translate(WORD_BYTES) if text else b""


class WindowIndex:
    """Windows of one benchmark block as sorted arrays; exact, as every match of hashes is compared word by word.

    `text` holds the items' words, a blank between two. A window is its hash, its place in text and its
    item, in the order of hashes, per window length: 28 bytes, besides 8 for every distinct word."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.ids, texts, found, at = [i for i, _ in items], [], {}, 0
        words = [np.zeros(0, np.uint64)]
        self.powers = np.random.default_rng(7).integers(1, 2**63, size=n, dtype=np.uint64) | np.uint64(1)
        for k, (_, text) in enumerate(items):
            own = b" ".join(normalised(text).split())
            if not own:
                continue
            raw = np.frombuffer(own, np.uint8)
            h, blank = hashes_of_bytes(raw), np.flatnonzero(raw == 32)
            start, stop = np.concatenate(([0], blank + 1)), np.concatenate((blank, [len(own)]))
            size = min(n, len(h))
            m = len(h) - size + 1
            found.setdefault(size, []).append((self.sums(h, np.arange(m), size), at + start[:m], at + stop[size - 1 :], np.full(m, k, np.int32)))
            words.append(np.unique(h))
            texts.append(own)
            at += len(own)
        self.text, self.vocabulary, self.windows = b"".join(texts), np.unique(np.concatenate(words)), {}
        for size, parts in found.items():
            h, start, stop, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.windows[size] = h[order], start[order], stop[order], item[order]

    def sums(self, h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of `size` words that begin at the given words."""
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out += h[at + k] * self.powers[k]
        return out

    @property
    def nbytes(self) -> int:
        return len(self.text) + self.vocabulary.nbytes + sum(a.nbytes for w in self.windows.values() for a in w)

    def find(self, data: bytes) -> tuple[np.ndarray, set[str]]:
        """A mask of the hit words of normalised text and the ids of the items whose windows occur."""
        h, items = hashes_of_bytes(np.frombuffer(data, np.uint8)), set()
        mask, words = np.zeros(len(h), dtype=bool), None
        if not len(h) or not self.windows:
            return mask, items
        near = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.concatenate(([0], np.cumsum(self.vocabulary[near] == h)))
        for size, (hashes, start, stop, item) in self.windows.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(h) >= size else ()
            if not len(at):
                continue
            own = self.sums(h, at, size)
            first, last = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
            for i, a, z in zip(*(x[first < last].tolist() for x in (at, first, last)), strict=True):
                words = words or data.split()
                window = b" ".join(words[i : i + size])
                for k in range(a, z):
                    if self.text[start[k] : stop[k]] == window:
                        mask[i : i + size] = True
                        if (name := self.ids[item[k]]) is not None:
                            items.add(name)
        return mask, items


def runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def index_blocks(benchmark: DataFrame, n: int, block_bytes: int) -> tuple[int, Iterator]:
    """The number of blocks of at most about block_bytes of benchmark text, and their indexes, each broadcast when its turn comes.

    An index is about 5 times its text, and at most 20 times (words of one letter)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))

    def each():
        for k in range(count):
            part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
            yield benchmark.sparkSession.sparkContext.broadcast(WindowIndex([tuple(r) for r in part.toLocalIterator()], n))

    return count, each()


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = scan(documents, "doc_id", "text")
    count, indexes = index_blocks(benchmark, n, block_bytes)
    if count == 1:
        index = next(indexes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = digest(())
            for b in batches:
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    mask, items = index.value.find(normalised(text.as_py()))
                    hit = int(mask.sum())
                    rows.append((doc_id, len(mask), hit, len(items), digest(items) if items else none, hit > 0))
                yield arrow_batch(HITS, rows)
            trim_memory()

        return docs.mapInArrow(run, HITS)

    found = []
    for index in indexes:
        found.append(materialise(docs.mapInArrow(spans_in(index), SPANS), "benchmark-hits"))
        index.destroy()
    merged = merge_blocks(found)
    words = docs.mapInArrow(count_words, "doc_id long, text_hash long, n_words long").alias("d")
    joined = words.join(merged.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "d.doc_id",
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def text_key(text: str | None) -> int:
    import xxhash

    return 0 if text is None else xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 1) >> 1


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        rows = [(i, text_key(t), len(normalised(t).split())) for i, t in zip(b.column(0).to_pylist(), texts, strict=True)]
        yield arrow_batch("doc_id long, text_hash long, n_words long", rows)


def spans_in(index):
    """Rows of SPANS for one block: documents with a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mask, items = index.value.find(normalised(text))
                if mask.any():
                    rows.append((doc_id, text_key(text), sorted(items), *runs(mask)))
            yield arrow_batch(SPANS, rows)
        trim_memory()

    return run


def merge_blocks(parts: list[DataFrame]) -> DataFrame:
    """Union of the blocks' spans per document id and text, which repeated rows share."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    grouped = every.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))))).alias("raw"),
    )
    joined = F.aggregate(
        "raw",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))),
    )
    return grouped.select("doc_id", "text_hash", "items", joined.alias("spans"))


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents with hit words cut out of their text; n_chars, where present, is set anew.

    The characters from the first to the last hit word of a run go; the rest stays byte for byte.
    The benchmark must fit one block (checked)."""
    count, indexes = index_blocks(benchmark, n, 64 << 20)
    if count > 1:
        raise ValueError("remove_spans takes benchmarks of up to 64 MB; filter by contamination() beyond that")
    index = next(indexes)

    @F.pandas_udf("string")
    def cut(texts):
        import re

        word = re.compile(rb"[0-9a-z\x80-\xff]+")

        def one(text):
            raw = text.encode("utf-8", "replace") if text else b""
            mask, _ = index.value.find(raw.translate(WORD_BYTES))
            if not mask.any():
                return text
            at = [m.span() for m in word.finditer(raw.lower())]
            kept, last = [], 0
            for s, e in zip(*runs(mask), strict=True):
                kept.append(raw[last : at[s][0]])
                last = at[e - 1][1]
            return b"".join([*kept, raw[last:]]).decode("utf-8", "replace")

        return texts.map(one, na_action="ignore")

    out = documents.withColumn("text", cut("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out


def op10_decontamination(spark, sf_dir):
    """HITS of every document against the whole benchmark; nulls, empty and repeated rows as stated above."""
    from .common import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
