"""Sinks: graphs and tables written by distributed writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _joined(frame: DataFrame) -> DataFrame:
    """Lists as text with | between, as flat formats need."""
    kinds = dict(frame.dtypes)
    return frame.select(*[F.array_join(c, "|").alias(c) if kinds[c].startswith("array") else F.col(c) for c in frame.columns])


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and lists joined. One file per partition."""
    _joined(frame).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_graph_csv(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """An edge list and a node list side by side; the nodes' columns are fixed, isolated ones included."""
    write_csv(edges.select(F.col("src").alias("source"), F.col("dst").alias("target")), f"{path}_edges")
    write_csv(nodes, f"{path}_nodes")


def write_json_lines(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """A node-link graph as JSON lines, each marked as node or link."""
    rows = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    links = edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"))).alias("value"))
    rows.unionByName(links).write.mode("overwrite").text(path)


def escaped(text: Column) -> Column:
    """Text safe in XML."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def graphml_lines(edges: DataFrame, nodes: DataFrame, ident: str) -> DataFrame:
    """(part, line): head, nodes, edges and foot of a GraphML document; null is empty, lists are joined."""
    flat = _joined(nodes)
    fields = [c for c in flat.columns if c != ident]
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[f'<key id="{c}" for="node" attr.name="{c}" attr.type="string"/>' for c in fields], '<graph edgedefault="directed">']
    frame = lambda part, lines: spark.createDataFrame([(part, x) for x in lines], "part int, line string")
    data = F.concat(*[F.concat(F.lit(f'<data key="{c}">'), escaped(F.col(c)), F.lit("</data>")) for c in fields]) if fields else F.lit("")
    body = flat.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), escaped(F.col(ident)), F.lit('">'), data, F.lit("</node>")).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('"/>')).alias("line"))
    return frame(0, head).unionByName(body).unionByName(links).unionByName(frame(3, ["</graph>", "</graphml>"]))


def write_graphml(edges: DataFrame, nodes: DataFrame, path: str, ident: str = "id") -> None:
    """GraphML whose part files, read in order, are one document (range-partitioned by part)."""
    graphml_lines(edges, nodes, ident).repartitionByRange(8, "part").sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)


def export(edges: DataFrame, nodes: DataFrame, path: str, kind: str) -> None:
    """Write a graph as csv, json or graphml."""
    writers = {"csv": write_graph_csv, "json": write_json_lines, "graphml": write_graphml}
    if kind not in writers:
        raise ValueError(f"unknown format {kind}")
    writers[kind](edges, nodes, path)
