"""Detector of bundled or minified code: fingerprints, then line length, then short identifiers; cheap tests first.

The cascade is one CASE, whose branches Spark evaluates only as far as needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bare

# Marks that bundlers and minifiers leave in their output.
FINGERPRINTS = (
    "__webpack_require__",
    "webpackChunk",
    "webpackJsonp",
    "_classCallCheck",
    "_interopRequireDefault",
    "//# sourceMappingURL=",
    "var _0x",
    "function _0x",
    "(function(_0x",
    "while (!![]) {",
    "eval(function(p,a,c,k,e,d)",
    "eval(function(p,a,c,k,e,r)",
    "[][(![]+",
    "__esmMin",
    "__commonJS",
    "var __defProp",
    "var __getOwnPropDesc",
)
MOST_BYTES_PER_LINE = 250
LEAST_IDENTIFIERS = 50
MOST_SHORT_SHARE = 0.55


def first_fingerprint(code: Column) -> Column:
    hit = F.filter(F.array(*map(F.lit, FINGERPRINTS)), lambda f: F.contains(code, f))
    return F.get(hit, 0)


def bytes_per_line(code: Column) -> Column:
    """Bytes of the whole text over its lines that are not blank."""
    lines = F.size(F.filter(F.split(code, "\n"), lambda x: bare(x) != ""))
    return F.octet_length(code) / F.nullif(lines, F.lit(0)).cast("double")


def identifiers(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit("([a-zA-Z_$][a-zA-Z0-9_$]*)"), F.lit(1))


def short_share(code: Column) -> Column:
    found = identifiers(code)
    return F.size(F.filter(found, lambda i: F.length(i) <= 2)) / F.nullif(F.size(found), F.lit(0)).cast("double")


def detect(df: DataFrame, code: str = "content") -> DataFrame:
    """df with code_type (Empty, CompiledCode, SourceCode) and reason."""
    c = F.coalesce(F.col(code), F.lit(""))
    blank, mark, width = bare(c) == "", first_fingerprint(c), bytes_per_line(c)
    few, share = F.size(identifiers(c)) < LEAST_IDENTIFIERS, short_share(c)
    kind = (
        F.when(blank, "Empty").when(mark.isNotNull(), "CompiledCode").when(width > MOST_BYTES_PER_LINE, "CompiledCode")
        .when(few, "SourceCode").when(share > MOST_SHORT_SHARE, "CompiledCode").otherwise("SourceCode")
    )
    reason = (
        F.when(blank, "empty").when(mark.isNotNull(), F.concat(F.lit("fingerprint: "), mark)).when(width > MOST_BYTES_PER_LINE, "line length")
        .when(few, "few identifiers").when(share > MOST_SHORT_SHARE, "short identifiers").otherwise("source")
    )
    return df.withColumn("code_type", kind).withColumn("reason", reason)


def skip_compiled(files: DataFrame) -> DataFrame:
    """Files without .js and .jsx ones that the detector takes for compiled code; other files are not examined."""
    js = F.lower(F.col("path")).rlike(r"\.jsx?$")
    return detect(files).where(~js | (F.col("code_type") == "SourceCode")).drop("code_type", "reason")
