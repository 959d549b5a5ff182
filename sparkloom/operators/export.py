"""Graph exports as lines of text: DOT, GraphML, GEXF and JSON. Lines come from column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml(c: Column) -> Column:
    """The text of a column with XML's five characters escaped."""
    out = F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_edges(calls: DataFrame) -> DataFrame:
    """line of every edge; unresolved calls are dashed."""
    style = F.when(F.col("is_resolved"), F.lit(";")).otherwise(F.lit(" [style=dashed];"))
    target = F.coalesce(F.col("callee_id").cast("string"), F.col("callee_name") if "callee_name" in calls.columns else F.lit("unresolved"))
    return calls.select(F.concat(F.lit("  "), quoted(F.col("caller_id")), F.lit(" -> "), quoted(target), style).alias("line"))


def dot_nodes(functions: DataFrame) -> DataFrame:
    return functions.select(F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), quoted(F.col("name")), F.lit("];")).alias("line"))


def document(head: list[str], parts: list[DataFrame], foot: list[str]) -> DataFrame:
    """section and line of a whole file: sort by section, or write each section after the other."""
    spark = parts[0].sparkSession
    out = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "section int, at int, line string")
    for k, p in enumerate(parts, 1):
        out = out.unionByName(p.select(F.lit(k).alias("section"), F.lit(0).alias("at"), "line"))
    return out.unionByName(spark.createDataFrame([(len(parts) + 1, i, x) for i, x in enumerate(foot)], "section int, at int, line string"))


def dot(functions: DataFrame, calls: DataFrame) -> DataFrame:
    return document(["digraph calls {"], [dot_nodes(functions), dot_edges(calls)], ["}"])


def graphml(functions: DataFrame, calls: DataFrame) -> DataFrame:
    node = functions.select(F.concat(F.lit('    <node id="'), xml(F.col("id")), F.lit('"><data key="name">'), xml(F.col("name")), F.lit('</data><data key="file">'), xml(F.col("file_path")), F.lit("</data></node>")).alias("line"))
    edge = calls.where("callee_id is not null").select(F.concat(F.lit('    <edge source="'), xml(F.col("caller_id")), F.lit('" target="'), xml(F.col("callee_id")), F.lit('"><data key="line">'), F.col("line_number").cast("string"), F.lit("</data></edge>")).alias("line"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="name" for="node" attr.name="name" attr.type="string"/>', '  <key id="file" for="node" attr.name="file" attr.type="string"/>', '  <key id="line" for="edge" attr.name="line" attr.type="int"/>', '  <graph edgedefault="directed">']
    return document(head, [node, edge], ["  </graph>", "</graphml>"])


def gexf(functions: DataFrame, calls: DataFrame) -> DataFrame:
    node = functions.select(F.concat(F.lit('      <node id="'), xml(F.col("id")), F.lit('" label="'), xml(F.col("name")), F.lit('"/>')).alias("line"))
    edge = calls.where("callee_id is not null").select(F.concat(F.lit('      <edge id="'), F.md5(F.concat_ws("\x1f", F.col("caller_id").cast("string"), F.col("callee_id").cast("string"), F.col("line_number").cast("string")).cast("binary")), F.lit('" source="'), xml(F.col("caller_id")), F.lit('" target="'), xml(F.col("callee_id")), F.lit('"/>')).alias("line"))
    between = functions.sparkSession.createDataFrame([("    </nodes>",), ("    <edges>",)], "line string").coalesce(1)
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '  <graph defaultedgetype="directed">', "    <nodes>"]
    return document(head, [node, between, edge], ["    </edges>", "  </graph>", "</gexf>"])


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def from_json_rows(rows: DataFrame, ddl: str) -> DataFrame:
    return rows.select(F.from_json("json", ddl).alias("r")).select("r.*")


def write_lines(doc: DataFrame, path: str) -> None:
    """A document() written in order, as text files whose names sort as its lines do."""
    doc.repartitionByRange("section", "at", "line").sortWithinPartitions("section", "at", "line").select("line").write.text(path)
