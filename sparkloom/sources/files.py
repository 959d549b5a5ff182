"""Source trees as tables: scan, filters, languages, projects and configuration."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILES

# Folders that are not scanned, extensions of the index, languages by extension.
SKIPPED = ("target", "node_modules", "__pycache__", "out")
EXTENSIONS = ("cpp", "cc", "cxx", "c++", "c", "h", "hpp", "hxx", "hh", "inl", "inc", "tpp", "tpl", "py", "py3", "pyx", "java", "rs", "ts", "tsx", "js", "jsx", "go")
INDEX_LANGUAGES = {
    "rust": ("rs",),
    "python": ("py", "py3", "pyx"),
    "typescript": ("ts", "tsx"),
    "javascript": ("js", "jsx"),
    "java": ("java",),
    "cpp": ("cpp", "cc", "cxx", "c++", "c", "h", "hpp", "hxx", "hh"),
    "go": ("go",),
}
DISPLAY_LANGUAGES = {
    "rust": ("rs",),
    "go": ("go",),
    "python": ("py", "pyw"),
    "javascript": ("js", "mjs", "cjs"),
    "typescript": ("ts",),
    "tsx": ("tsx",),
    "jsx": ("jsx",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"),
    "csharp": ("cs",),
    "ruby": ("rb",),
    "swift": ("swift",),
    "php": ("php",),
    "lua": ("lua",),
    "zig": ("zig",),
}


def extension(path: Column) -> Column:
    """The lower-cased extension, empty where the file name has none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def language(path: Column, table: dict[str, tuple[str, ...]] = INDEX_LANGUAGES) -> Column:
    ext, out = extension(path), F.lit("unknown")
    for name, exts in table.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def display_language(path: Column) -> Column:
    return language(path, DISPLAY_LANGUAGES)


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def scanned(path: Column) -> Column:
    """Whether no folder of a relative path is hidden or one of the skipped ones."""
    return ~path.rlike(r"(?:^|/)(?:\.[^/]*|" + "|".join(SKIPPED) + r")/")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """FILES of all supported source files under root, with paths relative to it.

    The filter on names runs before any content is read (glob and path filter of the file source)."""
    base = root.rstrip("/")
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    bare = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rel = F.replace(bare, F.lit(f"/{base.split('://')[-1].lstrip('/')}/"), F.lit(""))
    kept = raw.withColumn("path", rel).where(scanned(F.col("path")))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return kept.select(
        "path", F.coalesce(text, F.decode("content", "ISO-8859-1")).alias("content"), F.md5("content").alias("md5"), F.col("length").alias("size"), language(F.col("path")).alias("language"), F.col("modificationTime").alias("mtime")
    )


def files_from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """FILES from (path, content) pairs."""
    df = spark.createDataFrame(rows, "path string, content string")
    return df.select("path", "content", F.md5(F.col("content").cast("binary")).alias("md5"), F.octet_length("content").cast("long").alias("size"), language(F.col("path")).alias("language"), F.lit(None).cast("timestamp").alias("mtime"))


def empty_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILES)


def project_root(start: str | Path) -> Path:
    """The nearest folder at or above start that holds .git, else start itself."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / ".git").exists()), here)


def project_id(root: str | Path) -> str:
    return hashlib.md5(str(root).encode()).hexdigest()


@dataclasses.dataclass
class Config:
    """Search and embedding settings; unknown keys of a file are ignored."""

    channel_limit: int = 100
    rrf_k: int = 60
    rrf_top_k: int | None = None
    min_chunk_chars: int = 16
    rerank_top_n: int = 10
    rerank_pool_multiplier: int = 5
    embedding_dims: int = 64
    tokenizer: str = "code"

    @staticmethod
    def load(path: str | Path) -> Config:
        """Defaults where the file is missing."""
        p = Path(path)
        given = json.loads(p.read_text()) if p.exists() else {}
        names = {f.name for f in dataclasses.fields(Config)}
        return Config(**{k: v for k, v in given.items() if k in names})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(dataclasses.asdict(self), indent=1))
