"""Change detection by content hash, per-file replacement, deletes that reach every table, atomic snapshots."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hashes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path).alias("path"), F.md5(F.coalesce(F.col(content), F.lit("")).cast("binary")).alias("md5"))


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and status (new, changed, unchanged, deleted) from two hash tables (path, md5)."""
    j = old.select("path", F.col("md5").alias("old_md5")).join(new.select("path", F.col("md5").alias("new_md5")), "path", "full_outer")
    status = F.when(F.col("old_md5").isNull(), "new").when(F.col("new_md5").isNull(), "deleted").when(F.col("old_md5") == F.col("new_md5"), "unchanged").otherwise("changed")
    return j.select("path", status.alias("status"))


def replace_files(table: DataFrame, fresh: DataFrame, changed: DataFrame, column: str = "file_path") -> DataFrame:
    """table without the rows of changed paths (path), plus the rows made anew."""
    kept = table.join(changed.select(F.col("path").alias(column)).distinct(), column, "left_anti")
    return kept.select(*table.columns).unionByName(fresh.select(*table.columns))


def propagate_deletes(tables: dict[str, DataFrame], deleted: DataFrame, column: str = "file_path") -> dict[str, DataFrame]:
    """Every table without the rows of deleted paths (path)."""
    gone = deleted.select(F.col("path").alias(column)).distinct()
    return {k: t.join(gone, column, "left_anti").select(*t.columns) for k, t in tables.items()}


def merge_missing(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """table plus those fresh rows whose keys it lacks."""
    return table.unionByName(fresh.join(table.select(*keys).distinct(), keys, "left_anti").select(*table.columns))


def remove_file_from_graph(functions: DataFrame, calls: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions without those of the paths, and calls both of whose ends stay (unresolved ones by their caller)."""
    f = functions.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    ids = f.select("id").distinct()
    c = calls.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi")
    known = c.join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")
    return f, known.select(*calls.columns).unionByName(c.where("callee_id is null").select(*calls.columns))


class Snapshots:
    """Versioned table folders under one root and a pointer file that names the current one.

    A version is written whole, then the pointer is replaced by an overwriting rename; readers see the
    old or the new version. Through Hadoop's file systems, so the root may be on any store that they know."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        p = self._path(f"{self.root}/CURRENT")
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["version"]
        finally:
            stream.close()

    def write(self, tables: dict[str, DataFrame]) -> str:
        version = uuid.uuid4().hex[:16]
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/v-{version}/{name}")
        tmp = self._path(f"{self.root}/CURRENT-{version}")
        self.fs.mkdirs(self._path(self.root))
        stream = self.fs.create(tmp, True)
        stream.write(json.dumps({"version": version, "tables": sorted(tables)}).encode())
        stream.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        over = sc._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(tmp.toUri(), sc._jsc.hadoopConfiguration()).rename(tmp, self._path(f"{self.root}/CURRENT"), over)
        return version

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The table of the current version; empty where there is none yet and a schema is given."""
        version = self.current()
        path = f"{self.root}/v-{version}/{name}"
        if version is None or not self.fs.exists(self._path(path)):
            if schema is None:
                raise FileNotFoundError(f"no table {name} in {self.root}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(path)

    def prune(self, older_than: float = 0.0) -> int:
        """Deletes the versions that are not current and were written over older_than seconds ago."""
        keep, n, least = self.current(), 0, (time.time() - older_than) * 1000
        for f in self.fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith("v-") and name != f"v-{keep}" and f.getModificationTime() <= least:
                self.fs.delete(f.getPath(), True)
                n += 1
        return n

    @contextmanager
    def exclusive(self, wait: float = 60.0, stale: float = 6 * 3600.0):
        """The writers' lock: a file that is created only if it is not there. TimeoutError after `wait` seconds; a lock
        of over `stale` seconds is one whose owner died, and is taken over."""
        lock, until, me = self._path(f"{self.root}/LOCK"), time.time() + wait, uuid.uuid4().hex
        self.fs.mkdirs(self._path(self.root))
        while True:
            try:
                stream = self.fs.create(lock, False)
                stream.write(me.encode())
                stream.close()
                break
            except Exception as e:
                if not self.fs.exists(lock):
                    if time.time() > until:
                        raise
                elif time.time() * 1000 - self.fs.getFileStatus(lock).getModificationTime() > stale * 1000:
                    self.fs.delete(lock, False)
                    continue
                elif time.time() > until:
                    raise TimeoutError(f"another writer holds {lock.toString()}") from e
                time.sleep(0.2)
        try:
            yield
        finally:
            self.fs.delete(lock, False)

    def drop(self) -> None:
        self.fs.delete(self._path(self.root), True)


# Names of the ways to store a graph.
MODES = ("parquet", "json", "both")


def save_graph(functions: DataFrame, calls: DataFrame, folder: str, mode: str = "parquet") -> None:
    """Functions and calls as tables in a folder: Parquet, JSON lines or both."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    for name, df in (("functions", functions), ("calls", calls)):
        for kind in MODES[:2]:
            if mode in (kind, "both"):
                df.write.mode("overwrite").format(kind).save(f"{folder.rstrip('/')}/{name}.{kind}")


def load_graph(spark: SparkSession, folder: str, functions: str, calls: str, mode: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """The functions and calls of a folder, with these DDL schemas; `both` reads Parquet."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    kind = "json" if mode == "json" else "parquet"
    f, c = (spark.read.schema(ddl).format(kind).load(f"{folder.rstrip('/')}/{name}.{kind}") for name, ddl in (("functions", functions), ("calls", calls)))
    return f, c


def compact(df: DataFrame, target_rows: int = 1 << 20) -> DataFrame:
    """df dealt into files of about target_rows rows."""
    return df.repartition(max(1, -(-df.count() // target_rows)))
