"""Delta-maintained token-count rollups.

A change is a row (source, lang, tokenizer, old_tokens, new_tokens): an insert has no old count, a
delete no new one, a revision both. It adds new - old tokens and one, minus one or no documents to
the totals of its group, so totals are kept without looking at any other document.

A batch is committed under an id: its changes are summed per group, written to a staging folder of
the attempt, and the folder is renamed to the batch's own name. The rename replaces nothing and is
atomic on HDFS and local disks, so a batch is there whole or not at all, and committing an id again
does nothing. A driver that dies at any point leaves a staging folder at most, which nobody reads.
(Stores whose folders cannot be renamed in one step need a committer of their own.)

Totals are the sum over the newest base and the batches that it does not hold. `compact` folds both
into the next base; bases are numbered and their names are taken by the same rename, so of two
compactions at once one wins and the other is thrown away. `vacuum` deletes staging folders and the
data of held batches; their empty folders stay, and keep the ids committed. Only sums by group are
ever shuffled, combined before.

Edge cases: null source, lang or tokenizer are groups of their own; null counts on both sides are
no change; an empty batch is sealed and changes nothing; groups whose documents and tokens are
both back at zero are not listed; repeated rows are repeated changes; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, arrow_batch, fresh_path, materialise, scan, table, trim_memory

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def delta(changes: DataFrame) -> DataFrame:
    """Additive sums of signed changes per group."""
    old, new = F.col("old_tokens").cast("long"), F.col("new_tokens").cast("long")
    count = lambda c: F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    signed = changes.select(*KEYS, (count(new) - count(old)).alias("n_docs"), (F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).alias("n_tokens"))
    return signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """A store of batches in a folder that driver and executors share: batches/<id>, bases/<number> and staging."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop, self.conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)
        for part in ("batches", "bases", "staging"):
            self.fs.mkdirs(self.path(part))

    def path(self, *parts: str):
        return self.hadoop.Path("/".join((self.folder, *parts)))

    def _names(self, part: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(part)))

    def _batch(self, batch_id: str):
        if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9._-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return self.path("batches", batch_id)

    def _publish(self, name: str, target) -> bool:
        """Renames a staging folder to target; False if that is there already, and the folder is deleted."""
        staged = self.path("staging", name)
        options = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0)
        try:
            self.hadoop.FileContext.getFileContext(staged.toUri(), self.conf).rename(staged, target, options)
        except Exception:
            if not self.fs.exists(target):
                raise
            self.fs.delete(staged, True)
            return False
        return True

    def _base(self) -> tuple[int, set[str]]:
        """The number of the newest base (0: none) and the ids that it holds."""
        numbers = [int(n) for n in self._names("bases")]
        if not numbers:
            return 0, set()
        stream = self.fs.open(self.path("bases", str(max(numbers)), "_held"))
        try:
            return max(numbers), set(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def has(self, batch_id: str) -> bool:
        return self.fs.exists(self._batch(batch_id))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of changes to the totals; False, and no work, if the id was committed before."""
        if self.has(batch_id):
            return False
        name = f"{batch_id}-{uuid.uuid4().hex[:12]}"
        delta(changes).write.parquet(str(self.path("staging", name)))
        return self._publish(name, self._batch(batch_id))

    def _sums(self, base: int, batches: list[str]) -> DataFrame:
        folders = [str(self.path("batches", b)) for b in batches] + ([str(self.path("bases", str(base)))] if base else [])
        every = self.spark.read.schema(SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], SUMS)
        sums = every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all batches."""
        base, held = self._base()
        return self._sums(base, [b for b in self._names("batches") if b not in held])

    def compact(self) -> bool:
        """Folds the batches so far into the next base; False if another compaction was first. Ids stay committed."""
        base, held = self._base()
        fresh = [b for b in self._names("batches") if b not in held]
        name = f"base-{uuid.uuid4().hex[:12]}"
        self._sums(base, fresh).write.parquet(str(self.path("staging", name)))
        stream = self.fs.create(self.path("staging", name, "_held"), True)
        stream.write(json.dumps(sorted({*held, *fresh})).encode())
        stream.close()
        return self._publish(name, self.path("bases", str(base + 1)))

    def vacuum(self, older_than: float) -> int:
        """Deletes data that no reading begun in the last `older_than` seconds needs: old staging folders, bases before the
        newest and the data of the batches it holds. Returns the number of folders. Bases and batches count from the newest base on."""
        base, held = self._base()
        least, n = (time.time() - older_than) * 1000, 0
        for f in self.fs.listStatus(self.path("staging")):
            if f.getModificationTime() < least:
                n += self.fs.delete(f.getPath(), True)
        if base and self.fs.getFileStatus(self.path("bases", str(base), "_held")).getModificationTime() < least:
            for k in self._names("bases"):
                if int(k) < base:
                    n += self.fs.delete(self.path("bases", k), True)
            for b in held:
                self.fs.create(self.path("batches", b, "_held"), True).close()  # not empty: a rename cannot take its place
                files = [f.getPath() for f in self.fs.listStatus(self.path("batches", b)) if not f.getPath().getName().startswith("_held")]
                n += bool(files)
                for f in files:
                    self.fs.delete(f, True)
        return n


def repeats(docs: DataFrame, *columns: str, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """The columns of every row whose text others have too, and of the one row of each such text that comes first:
    by doc_id, nulls last, then by the columns. Firsts are combined before the shuffle; the rows of a text are
    dealt over salts to meet theirs. Texts are read once; their digests are written."""
    key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    light = materialise(docs.select(key.alias("key"), "doc_id", *columns), "rollup-texts")
    light = light.select("key", F.pmod(F.xxhash64("doc_id", *columns), F.lit(salts)).cast("int").alias("salt"), F.struct(F.col("doc_id").isNull(), "doc_id", *columns).alias("place"), *columns)
    first = light.groupBy("key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    keys = first.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return light.join(keys, ["key", "salt"]).select(*columns), first.select(*(F.col("place")[c].alias(c) for c in columns))


def op4_token_rollups(spark, sf_dir):
    """Totals of all documents after four batches: provisional counts from n_chars for every document
    (tokenizer words-v1), their revision to the exact word counts, the insert of byte counts
    (bytes-v1), and, for texts that several rows have, the withdrawal of all of these and the insert of
    one. Two batches are delivered twice. Both tokenizers are rules that SQL can count; token_rollups_bpe has a trained one."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")
    none, guess = F.lit(None).cast("long"), F.floor(F.coalesce("n_chars", F.lit(0)) / 6).cast("long")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    octets = F.octet_length(text).cast("long")
    first = change(docs, "words-v1", none, guess)
    rollup.commit("0001-provisional", first)
    rollup.commit("0002-exact", change(docs, "words-v1", guess, words))
    rollup.commit("0001-provisional", first)
    rollup.commit("0003-bytes", change(docs, "bytes-v1", none, octets))
    rollup.compact()
    every, first = repeats(docs.withColumns({"words": words, "octets": octets}), "source", "lang", "words", "octets")
    both = lambda df, old, new: change(df, "words-v1", old("words"), new("words")).union(change(df, "bytes-v1", old("octets"), new("octets")))
    gone = both(every, F.col, lambda _: none).union(both(first, lambda _: none, F.col))
    rollup.commit("0004-withdrawn", gone)
    rollup.commit("0003-bytes", gone)
    return rollup.totals()


def change(df: DataFrame, tokenizer: str, old, new) -> DataFrame:
    """Rows of changes of one tokenizer version."""
    return df.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), old.alias("old_tokens"), new.alias("new_tokens"))


def bpe_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """source, lang and n_tokens of every row: the length of its text under a tokenizer file; null texts have 0."""
    from .packing import ChunkTokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    ddl = "source string, lang string, n_tokens long"

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = ChunkTokenizer.load(definition.value)
        for b in batches:
            source, lang = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield arrow_batch(ddl, [(s, k, len(ids)) for s, k, ids in zip(source, lang, tok.encode(b.column(3)), strict=True)])
        trim_memory()

    return scan(docs, "doc_id", "source", "lang", "text").mapInArrow(run, ddl)


def token_rollups_bpe(spark, sf_dir):
    """Totals of all documents by source and language under the public 49k word BPE, after two batches: provisional
    counts from n_chars, and their revision to the tokenizer's own, group by group as additive deltas."""
    from .packing import default_tokenizer

    docs, version, none = table(spark, sf_dir, "documents"), "word-bpe-49k", F.lit(None).cast("long")
    guess = F.floor(F.coalesce("n_chars", F.lit(0)) / 4).cast("long")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    rollup.commit("0001-provisional", change(docs, version, none, guess))
    counted = change(bpe_counts(docs, default_tokenizer()), version, none, F.col("n_tokens"))
    rollup.commit("0002-exact", change(docs, version, guess, none).unionByName(counted))
    return rollup.totals()


OP4_SQL = r"""
WITH d AS (
  SELECT source, lang, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS k
  FROM documents
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM (SELECT source, lang, 'words-v1' AS tokenizer, n_words AS n FROM d WHERE k = 1
      UNION ALL SELECT source, lang, 'bytes-v1', n_bytes FROM d WHERE k = 1)
GROUP BY source, lang, tokenizer
"""
