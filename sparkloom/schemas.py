"""Tables of the engine as DDL, and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "path string, content string, md5 string, size long, language string, mtime timestamp"
SYMBOLS = (
    "file_path string, language string, kind string, name string, symbol_id string, parent_id string, "
    "start_row int, end_row int, decl_end_row int, start_byte int, end_byte int, signature string, "
    "class_type string, bases array<string>, type_name string, is_error boolean"
)
FUNCTIONS = "id string, name string, file_path string, line_start int, line_end int, namespace string, language string, signature string"
CALLS = "caller_id string, callee_id string, caller_name string, callee_name string, caller_file string, callee_file string, line_number int, is_resolved boolean"
CLASSES = (
    "id string, name string, file_path string, line_start int, line_end int, namespace string, language string, class_type string, "
    "parent_class string, implemented_interfaces array<string>, member_functions array<string>, member_variables array<string>"
)
CHUNKS = "snippet_id string, file_path string, content string, symbol_name string, symbol_type string, language string, line_start int, line_end int"
VECTORS = "id string, vector array<float>"
CACHE = "hash string, vector array<float>, created_at timestamp"
KNOWLEDGE = (
    "id string, title string, content string, type string, tags array<string>, related_files array<string>, "
    "source_agent string, task_id string, confidence float, access_count int, created_at string, updated_at string, last_accessed string, parent_ids array<string>"
)
HASHES = "path string, md5 string"
FILE_EVENTS = "path string, kind string, ts timestamp"

RELATION_TYPES = ("Call", "Import", "Inherit", "Implement")
CLASS_TYPES = ("Class", "Struct", "Interface", "Trait", "Enum")
EDGE_TYPES = ("Contains", "Inherits", "Implements", "Imports", "DefinesIn")


def stable_id(*parts: Column) -> Column:
    """md5 of the parts with a separator: the same row gets the same id in every run."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def function_id() -> Column:
    return stable_id(F.col("file_path"), F.col("line_start"), F.col("line_end"), F.col("name"))
