"""Call resolution: enclosing functions by interval join, callees by name, placeholders for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enclosing(calls: DataFrame, functions: DataFrame, block: int = 256, how: str = "innermost") -> DataFrame:
    """calls (call_id, file_path, line) with the function whose lines hold them: fn_id, or null.

    Lines are dealt into blocks, so the join is an equi-join on file and block with the range as a
    residual; one file of very many lines is spread over many keys. Nested functions: the innermost
    (latest start, then earliest end, then id), or the outermost."""
    span = functions.select(F.col("id").alias("fn_id"), "file_path", "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / block), F.floor(F.greatest("line_start", "line_end") / block))).alias("block"))
    keyed = calls.withColumn("block", F.floor(F.col("line") / block))
    hit = keyed.join(span, ["file_path", "block"]).where("line between line_start and line_end")
    key = F.struct(-F.col("line_start"), F.col("line_end"), F.col("fn_id")) if how == "innermost" else F.struct("line_start", -F.col("line_end"), F.col("fn_id"))
    best = hit.groupBy("call_id").agg(F.min_by("fn_id", key).alias("fn_id"))
    return calls.join(best, "call_id", "left")


def first_of_name(functions: DataFrame, *keys: str) -> DataFrame:
    """One id per key: the first by file and line. Homonyms are reduced before any join, so a common name is one row."""
    return functions.groupBy(*keys).agg(F.min_by("id", F.struct("file_path", "line_start", "id")).alias("id"))


def resolve_names(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (file_path, callee_name, ...) with callee_id, is_resolved and scope: same file first, then any file.

    A qualified name (A.b, A::b) that is unknown as such is looked up by its last part."""
    bare = F.element_at(F.split("callee_name", r"::|\."), -1)
    local = first_of_name(functions, "file_path", "name").select("file_path", F.col("name").alias("callee_name"), F.col("id").alias("local_id"))
    anywhere = first_of_name(functions, "name")
    out = calls.join(local, ["file_path", "callee_name"], "left")
    out = out.join(anywhere.select(F.col("name").alias("callee_name"), F.col("id").alias("global_id")), "callee_name", "left")
    out = out.withColumn("bare", F.when(F.col("callee_name").rlike(r"::|\."), bare)).join(anywhere.select(F.col("name").alias("bare"), F.col("id").alias("bare_id")), "bare", "left")
    callee = F.coalesce("local_id", "global_id", "bare_id")
    scope = F.when(F.col("local_id").isNotNull(), "local").when(F.col("global_id").isNotNull(), "global").when(F.col("bare_id").isNotNull(), "qualified").otherwise("unresolved")
    return out.withColumn("callee_id", callee).withColumn("is_resolved", callee.isNotNull()).withColumn("scope", scope).drop("bare", "local_id", "global_id", "bare_id")


def build_calls(call_symbols: DataFrame, functions: DataFrame) -> DataFrame:
    """The calls table from call symbols (file_path, line, callee_name).

    Calls outside any function are dropped; calls to unknown names stay with a null callee."""
    sites = call_symbols.groupBy("file_path", "line", "callee_name").agg(F.count(F.lit(1)).alias("times"))
    sites = sites.withColumn("call_id", F.md5(F.concat_ws("\x1f", "file_path", F.col("line").cast("string"), "callee_name").cast("binary")))
    inside = enclosing(sites, functions).where("fn_id is not null")
    named = resolve_names(inside, functions)
    f = lambda k: functions.select(F.col("id").alias(f"{k}_id"), F.col("name").alias(f"{k}_name_"), F.col("file_path").alias(f"{k}_file"))
    out = named.withColumnRenamed("fn_id", "caller_id").join(f("caller"), "caller_id").join(f("callee"), "callee_id", "left")
    return out.select(
        "caller_id", "callee_id", F.col("caller_name_").alias("caller_name"), F.coalesce("callee_name_", "callee_name").alias("callee_name"), "caller_file", "callee_file",
        F.col("line").cast("int").alias("line_number"), "is_resolved",
    )


def placeholders(calls: DataFrame) -> DataFrame:
    """A function row in namespace `unresolved` for every name that no call resolves."""
    names = calls.where("not is_resolved").select(F.col("callee_name").alias("name")).distinct()
    return names.select(F.md5(F.concat(F.lit("unresolved\x1f"), "name").cast("binary")).alias("id"), "name", F.lit("").alias("file_path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("unresolved").alias("namespace"), F.lit("unknown").alias("language"), F.lit(None).cast("string").alias("signature"))


def guessed_calls(functions: DataFrame) -> DataFrame:
    """Calls guessed where a file could not be parsed: main and entry call every other function of the
    file, and test or spec functions call those whose name theirs contains. Pairs stay within a file."""
    a = functions.select("file_path", F.col("id").alias("caller_id"), F.lower("name").alias("caller"), F.col("line_start").alias("line_number"))
    b = functions.select("file_path", F.col("id").alias("callee_id"), F.lower("name").alias("callee"))
    heads = a.where(F.col("caller").isin("main", "entry") | F.col("caller").contains("test") | F.col("caller").contains("spec"))
    pair = heads.join(b, "file_path").where("caller_id <> callee_id")
    rule = F.col("caller").isin("main", "entry") | (F.length("callee") > 0) & F.contains(F.col("caller"), F.col("callee"))
    return pair.where(rule).select("caller_id", "callee_id", "line_number", F.lit(True).alias("is_resolved"))
