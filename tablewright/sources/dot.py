"""Edges and nodes out of DOT graph text (regular expressions on a text column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import ref, trimmed, unrolled
from tablewright.sources.textlines import raw_lines


def _bare(c: Column) -> Column:
    """A node name without the blanks and quotes around it."""
    return F.btrim(c, F.lit(V.WHITESPACE + "\"'"))


def _found(df: DataFrame, id_: str, text: str, pattern: str) -> DataFrame:
    """(graph_id, p, match) for every match of the pattern."""
    matches = F.regexp_extract_all(ref(text), F.lit(pattern), F.lit(0))
    texts = df.select(ref(id_).alias("graph_id"), matches.alias("matches"))
    return unrolled(texts, F.col("matches"), "p", "match").drop("matches")


def _split(found: DataFrame) -> DataFrame:
    """Each match cut into what stands before its attribute list, and the list.

    Node names hold neither dashes nor brackets, so the parts are found
    without matching the pattern again.
    """
    match = F.col("match")
    inner = F.substring_index(F.substr(match, F.locate("[", match) + 1), "]", 1)
    return found.select(
        "graph_id",
        (F.col("p") + 1).alias("number"),
        F.substring_index("match", "[", 1).alias("head"),
        F.when(F.contains("match", F.lit("[")), inner).otherwise("").alias("attributes"),
    )


def dot_edges(df: DataFrame, id_: str = "graph_id", text: str = "dot") -> DataFrame:
    """(graph_id, edge_no, source_node, target_node, weight, attributes).

    In a chain ``a -> b -> c`` only the first pair is an edge, as matches do
    not overlap.
    """
    attributes = F.col("attributes")
    weight = F.when(
        F.contains(attributes, F.lit("weight")),
        F.regexp_extract(attributes, V.DOT_WEIGHT_PATTERN, 1).try_cast("double"),
    )
    return _split(_found(df, id_, text, V.DOT_EDGE_PATTERN)).select(
        "graph_id",
        F.col("number").alias("edge_no"),
        _bare(F.substring_index("head", "-", 1)).alias("source_node"),
        _bare(F.ltrim(F.substring_index("head", "-", -1), F.lit(">"))).alias("target_node"),
        F.coalesce(weight, F.lit(1.0)).alias("weight"),
        F.when(attributes != "", trimmed(attributes)).otherwise("default").alias("attributes"),
    )


def _without_edges(df: DataFrame, id_: str, text: str) -> DataFrame:
    return df.where(~ref(text).rlike(V.DOT_EDGE_PATTERN)).select(
        ref(id_).alias("graph_id"), ref(text).alias("dot")
    )


def dot_nodes(df: DataFrame, id_: str = "graph_id", text: str = "dot") -> DataFrame:
    """(graph_id, node_no, node_id, attributes) of graphs that have no edge."""
    found = _found(_without_edges(df, id_, text), "graph_id", "dot", V.DOT_NODE_PATTERN)
    return _split(found).select(
        "graph_id",
        F.col("number").alias("node_no"),
        _bare(F.col("head")).alias("node_id"),
        trimmed(F.col("attributes")).alias("attributes"),
    )


def dot_lines(
    df: DataFrame, id_: str = "graph_id", text: str = "dot", max_lines: int | None = None
) -> DataFrame:
    """(graph_id, line_no, raw_dot) of texts with neither edges nor nodes.

    ``max_lines=1000`` gives the first thousand lines; by default all are kept.
    """
    bare = _without_edges(df, id_, text).where(~F.col("dot").rlike(V.DOT_NODE_PATTERN))
    lines = raw_lines(F.col("dot"))
    kept = F.slice(lines, 1, max_lines) if max_lines else lines
    return unrolled(bare, kept, "p", "raw_dot").select(
        "graph_id", (F.col("p") + 1).alias("line_no"), "raw_dot"
    )
