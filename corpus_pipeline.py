"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but
the last return the columns of documents. Rows rejected by a stage are gone for those after it:
toxic texts, texts in no known language or in none clearly, all but one document of each group of
near copies, and documents with benchmark passages. The last stage packs what is left.

Edge cases, alike in every stage: a row is judged by its own id and text, told by a 64-bit key of
both, so null and repeated ids are nothing special. Null and empty texts are not toxic, have no
language (rejected), link with nothing and hold no passage. Rows that repeat id and text share a
verdict, but one of a group of near copies stays: the one with the smallest doc_id, nulls last.
Long texts are read whole. Empty tables, and stages that keep nothing, give empty tables. Extra
columns stay, whatever their names, as the operators get only id and text (and lang).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, jaccard, langid, packing, toxicity
from sparkloom.llm.common import delete, fresh_path, materialise, row_key, scratch, table

#: A text is rejected by language identification below this pooled probability.
LEAST_LANGUAGE_SCORE = 0.4
#: A text is rejected as toxic from this score on.
LEAST_TOXIC_SCORE = 0.7


def keyed(docs: DataFrame) -> DataFrame:
    """The rows' texts under their keys, for operators that judge a text by itself."""
    return docs.select(row_key().alias("doc_id"), "text")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose key is in gone (doc_id). gone is counted: up to two million keys filter as a
    broadcast where the texts are read; more are joined."""
    key = unused(docs)
    gone = gone.select(F.col("doc_id").alias(key)).distinct()
    n = gone.count()
    return docs.withColumn(key, row_key()).join(F.broadcast(gone) if n <= 2_000_000 else gone, key, "left_anti").drop(key)


def unused(docs: DataFrame) -> str:
    """A column name that docs does not have."""
    name, taken = "row_key", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that positive-unlabelled learning predicts to be toxic; those without a text are not."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    bad = toxicity.score(keyed(docs), model).where(F.col("score") >= LEAST_TOXIC_SCORE)
    return without(docs, materialise(bad.select("doc_id"), "toxic"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or text, and those whose best language has a low probability."""
    found = langid.predict(keyed(docs), langid.fit(docs))
    bad = found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_LANGUAGE_SCORE))
    return without(docs, materialise(bad.select("doc_id"), "unknown-language"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of the 5-word Jaccard join: the first by doc_id, nulls last. Rows without
    words are in no component and stay."""
    further = materialise(jaccard.further_rows(docs), "copies")
    rest = without(docs, further.select(F.col("row_key").alias("doc_id")))
    again = further.where("first").select("row_key")
    if again.isEmpty():
        return rest
    key = unused(docs)
    first = docs.withColumn(key, row_key()).join(again.withColumnRenamed("row_key", key), key, "left_semi")
    return rest.unionByName(first.dropDuplicates([key]).drop(key))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark window; those without a text hold none."""
    hits = decontamination.contamination(keyed(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, materialise(hits.where("contaminated").select("doc_id"), "contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of up to 4096 tokens; each row is a document of its own."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn models and tokenise, which SQL does not express. tests/llm/test_pipeline.py judges every row
#: of a table anew, pair by pair and window by window, and compares what is left and how it is packed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents of sf_dir that every stage keeps. What stages write is deleted behind them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
