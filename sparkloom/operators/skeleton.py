"""Skeletons: declarations without bodies, per top-level symbol and joined per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORTHY = ("struct", "function", "type_alias")
#: language: what opens a block with members, closes it, stands for a body, and ends a field.
STYLES = {
    "python": ("", None, None, ""),
    "rust": (" {", "}", " { ... }", ","),
    "cpp": (" {", "}", " { ... }", ";"),
    "typescript": (" {", "}", " { ... }", ";"),
    "javascript": (" {", "}", " { ... }", ","),
    "java": (" {", "}", " { ... }", ","),
    "go": (" {", "}", " { ... }", ","),
}


def skeleton_of(symbol: dict, children: list[dict], language: str) -> str:
    """The skeleton of one top-level symbol; declarations are stripped line by line."""
    opening, closing, body, end = STYLES.get(language, STYLES["rust"])
    lines = [x.strip() for x in symbol["declaration"].split("\n")]
    members = [c for c in children if c["kind"] in ("function", "field")]
    if language == "go" and symbol["kind"] == "struct":
        return symbol["content"].replace("\t", "  ")
    if language == "python":
        for c in members:
            lines += ["  " + x.strip() for x in c["declaration"].split("\n")]
            if c["kind"] == "function":
                lines.append("    ...")
        if symbol["kind"] == "function":
            lines.append("  ...")
        return "\n".join([*lines, ""])
    if not members:
        if not lines[-1].endswith((";", "}")):
            lines[-1] += body
        return "\n".join(lines)
    lines[-1] += opening
    for c in members:
        own = [x.strip() for x in c["declaration"].split("\n")]
        if not own[-1].endswith((";", "}")):
            own[-1] += body if c["kind"] == "function" else ("" if own[-1].endswith(end) else end)
        lines += ["  " + x for x in own]
    return "\n".join([*lines, closing])


SKELETONS = "file_path string, language string, symbol_id string, start_row int, skeleton string"


def skeletons(symbols: DataFrame) -> DataFrame:
    """A skeleton per top-level symbol worth showing. One task sees the symbols of one file at a time."""

    def run(key, pdf):
        import pandas as pd

        rows = pdf.sort_values(["start_row", "start_byte"]).to_dict("records")
        ids = {r["symbol_id"] for r in rows}
        below: dict = {}
        for r in rows:
            below.setdefault(r["parent_id"], []).append(r)
        out = [
            (r["file_path"], r["language"], r["symbol_id"], int(r["start_row"]), skeleton_of(r, below.get(r["symbol_id"], []), r["language"]))
            for r in rows
            if r["kind"] in WORTHY and r["parent_id"] not in ids
        ]
        return pd.DataFrame(out, columns=["file_path", "language", "symbol_id", "start_row", "skeleton"])

    return symbols.groupBy("file_path").applyInPandas(run, SKELETONS)


def file_skeletons(symbols: DataFrame) -> DataFrame:
    """file_path, language and the skeletons of a file's top-level symbols by row, an empty line between them."""
    s = skeletons(symbols).groupBy("file_path", "language").agg(F.array_sort(F.collect_list(F.struct("start_row", "symbol_id", "skeleton"))).alias("parts"))
    return s.select("file_path", "language", F.array_join(F.transform("parts", lambda p: p["skeleton"]), "\n\n").alias("skeleton_text"))


def file_text(symbols: DataFrame, parents: DataFrame) -> DataFrame:
    """file_path and skeleton: the `part` of symbols whose parent is not among parents (symbol_id), by start_row and h."""
    top = symbols.join(parents.select(F.col("symbol_id").alias("parent_id")).distinct(), "parent_id", "left_anti")
    s = top.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_row", "h", "part"))).alias("parts"))
    return s.select("file_path", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("skeleton"))


def batch_json(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """One row `json`: {success, data: {skeletons: [{filepath, language, skeleton_text}]}} for the paths (path).

    A file without symbols has an error text."""
    s = paths.select(F.col("path").alias("file_path")).join(file_skeletons(symbols), "file_path", "left")
    text = F.coalesce("skeleton_text", F.concat(F.lit("error: no symbols found in "), "file_path"))
    rows = s.select(F.struct(F.col("file_path").alias("filepath"), F.coalesce("language", F.lit("unknown")).alias("language"), text.alias("skeleton_text")).alias("r"))
    return rows.agg(F.array_sort(F.collect_list("r")).alias("skeletons")).select(F.to_json(F.struct(F.lit(True).alias("success"), F.struct("skeletons").alias("data"))).alias("json"))


def dedent(lines: list[str]) -> list[str]:
    """Lines without the white space that all of them start with."""
    full = [x for x in lines if x.strip()]
    n = min((len(x) - len(x.lstrip()) for x in full), default=0)
    return [x[n:] if x.strip() else "" for x in lines]


DECLARATIONS = "file_path string, symbol_id string, top_row int, bottom_row int, line string"


def declarations(symbols: DataFrame) -> DataFrame:
    """Whole functions, and structs without their bodies, with the comments directly above them, dedented.

    A Python class keeps the docstring below its declaration."""

    def run(key, pdf):
        import pandas as pd

        rows = pdf.sort_values("start_row").to_dict("records")
        comments, out = [r for r in rows if r["kind"] == "comment"], []
        for r in rows:
            if r["kind"] not in ("function", "struct"):
                continue
            whole = r["kind"] == "function"
            top, bottom, before = int(r["start_row"]), int(r["end_row"] if whole else r["decl_end_row"]), []
            if r["language"] == "python":
                doc = None if whole else next((c for c in comments if c["parent_id"] == r["symbol_id"] and c["start_row"] == r["decl_end_row"] + 1), None)
                own = dedent(r["content"].split("\n")) if whole else [r["declaration"], *(doc["content"].split("\n") if doc is not None else ()), "    ..."]
                bottom = int(doc["end_row"]) if doc is not None else bottom
            else:
                for c in reversed(comments):
                    if int(c["end_row"]) == top - 1:
                        before, top = c["content"].split("\n") + before, int(c["start_row"])
                own = dedent(r["content"].split("\n")) if whole else [r["declaration"] + " { ... }"]
            out.append((r["file_path"], r["symbol_id"], top, bottom, "\n".join(dedent(before) + own)))
        return pd.DataFrame(out, columns=["file_path", "symbol_id", "top_row", "bottom_row", "line"])

    return symbols.groupBy("file_path").applyInPandas(run, DECLARATIONS)
