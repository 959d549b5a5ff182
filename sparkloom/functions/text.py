"""Column functions on code and text: tokenizers, line slices, gates and penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space, as a set of characters to trim.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bare(c: Column) -> Column:
    """Text without the white space around it."""
    return F.trim(c, F.lit(WHITE))


def default_tokens(text: Column, longest: int = 40) -> Column:
    """Lower-cased runs of letters and digits, without those of over `longest` characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) <= longest)


def code_tokens(text: Column) -> Column:
    """Identifiers split at underscores and before every capital, lower-cased; the whole identifier follows its parts."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([a-zA-Z0-9_]+)"), F.lit(1))
    parts = lambda w: F.filter(F.regexp_extract_all(w, F.lit("([A-Z]?[^A-Z_]+|[A-Z])"), F.lit(1)), lambda p: p != "")
    # the parts of a word are bound once, by a transform of an array of one, as Spark shares nothing within a lambda
    each = lambda w: F.transform(F.array(parts(w)), lambda p: F.when(F.size(p) > 1, F.concat(p, F.array(w))).otherwise(p))
    return F.transform(F.flatten(F.flatten(F.transform(words, each))), lambda t: F.lower(t))


def tokens(text: Column, tokenizer: str = "code") -> Column:
    if tokenizer not in ("code", "default"):
        raise ValueError(f"tokenizer must be 'code' or 'default', not {tokenizer!r}")
    return code_tokens(text) if tokenizer == "code" else default_tokens(text)


def line_range(content: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1, both included); null where first lies beyond the end."""
    lines = F.split(content, "\n")
    start = F.greatest(first, F.lit(1))
    stop = F.least(last, F.size(lines))
    return F.when(start <= F.size(lines), F.array_join(F.slice(lines, start, F.greatest(stop - start + 1, F.lit(0))), "\n"))


def long_enough(content: Column, least: int = 16) -> Column:
    return F.length(bare(content)) >= least


def short_penalty(score: Column, content: Column, full: int = 30) -> Column:
    """score * (1 - (1 - len/full) / 2) where the trimmed content is shorter than `full`."""
    n = F.length(bare(content)).cast("double")
    return F.when(n < full, score * (1 - (1 - n / full) * 0.5)).otherwise(score)


def namespace(content: Column, language: Column) -> Column:
    """The first line that states a namespace, by language; the language's default otherwise."""
    found = lambda pattern: F.nullif(F.trim(F.regexp_extract(content, pattern, 1)), F.lit(""))
    return (
        F.when(language == "rust", F.coalesce(found(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"), F.lit("crate")))
        .when(language == "python", F.coalesce(found(r"(?m)^\s*__package__\s*=\s*[\"']([^\"']+)"), F.lit("global")))
        .when(language == "java", F.coalesce(found(r"(?m)^\s*package\s+([\w.]+)"), F.lit("default")))
        .when(language == "cpp", F.coalesce(found(r"(?m)^\s*(?:inline\s+)?namespace\s+([\w:]+)"), F.lit("global")))
        .when(language == "go", F.coalesce(found(r"(?m)^\s*package\s+(\w+)"), F.lit("main")))
        .otherwise(F.lit("global"))
    )


def truncate_bytes(content: Column, most: int = 64_000) -> Column:
    """At most `most` bytes, cut at a character; characters are counted only where bytes exceed the bound."""
    fits = F.octet_length(content) <= most
    chars = F.split(content, "")
    size = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, c: F.when(a["n"] + F.octet_length(c) <= most, F.struct((a["n"] + F.octet_length(c)).alias("n"), (a["k"] + F.length(c)).alias("k"))).otherwise(F.struct(F.lit(most + 1).alias("n"), a["k"].alias("k"))))
    return F.when(fits, content).otherwise(F.substring(content, F.lit(1), size["k"]))
