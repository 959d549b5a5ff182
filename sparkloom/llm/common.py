"""Shared folders, materialised tables and schemas of the operators in this package."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space between words, as in [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z to a-z, every other byte unchanged.
LOWER_BYTES = bytes(range(256)).lower()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (local mode, tests) a temporary folder is made once and kept for
    the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkloom.local.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("sparkloom.local.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append((name, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Names and paths of the tables that the open scratch() blocks have made, innermost last.
_OPEN: list[list[tuple[str, str]]] = []


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession, *keep: str):
    """Deletes the tables that materialise() makes within the block at its end, but for the last of each name to keep.

    Results that are read after the block must rest on kept tables only. The block is of one thread."""
    made: list[tuple[str, str]] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        kept = [(name, path) for name, path in {n: p for n, p in made}.items() if name in keep]
        for x in made:
            if x not in kept:
                delete(spark, x[1])
        if _OPEN:
            _OPEN[-1].extend(kept)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of texts, about, which bounds a Python worker's memory; one longer text is a batch.
BATCH_BYTES = "8m"


def scan(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """The id as long and the other columns, to be read in Arrow batches of about BATCH_BYTES.

    The bound is a session setting that Spark reads when the result is computed, so it stays set; a value
    that differs from Spark's default is the user's own and is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m") in ("67108864b", "64MB", "64m"):
        conf.set(key, BATCH_BYTES)
    return df.select(F.col(id_column).cast("long").alias(id_column), *columns)


def trim_memory() -> None:
    """Gives freed memory of a Python worker back to the system; workers outlive tasks and stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def crc_of_id(c: Column) -> Column:
    """crc32 of the id written as text; null ids give null."""
    return F.crc32(c.cast("string").cast("binary"))


def row_key(id_column: str = "doc_id") -> Column:
    """A 64-bit key of a document row: of its id, which may be null or repeat, and its text."""
    return F.xxhash64(F.col(id_column).cast("long"), "text")


def arrow_schema(ddl: str):
    """The Arrow schema of a flat DDL string; usable in Python workers, which have no session."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def arrow_batch(ddl: str, rows: list[tuple]):
    """Rows as one record batch of the DDL's schema."""
    import pyarrow as pa

    schema = arrow_schema(ddl)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
