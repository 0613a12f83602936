"""Connected components of a link table, as joins and aggregates only.

Each round has every node's neighbours point to the smallest of them (first the larger
neighbours, then the smaller ones); in a few rounds each component is a star around its smallest
node. Rounds are written to the shared folder, so lost executors cost one round at most. A node
with very many links is one aggregated row after partial aggregation and a side that Spark splits
in a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.lookup import lookup
from tablewright.session import cut_lineage

MAX_ROUNDS = 200


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest member) of every node that has a link.

    Null ends, links of a node with itself and repeated links are ignored; no links give no rows.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    edges = cut_lineage(links.where(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        edges = cut_lineage(_small_star(cut_lineage(_large_star(edges))))
        # A round that changes nothing leaves every node linked to its root alone.
        state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return cut_lineage(leaves.unionByName(roots.withColumn("component", F.col("node"))))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    moved = both.where(F.col("v") > F.col("u")).join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def named(rows: DataFrame) -> DataFrame:
    """Components of numbered rows by their ids: ``rows`` with ``component_id`` and ``kept``.

    ``rows`` has a ``row`` number, an ``own_id`` that may be null or repeat, and a ``component``; it
    should be a written table. A component has its smallest id, null if it has none, and keeps one
    row: the first with that id, by row number.
    """
    first = F.min(F.struct(F.col("own_id").isNull().alias("missing"), "own_id", "row")).alias("first")
    found = lookup(rows, rows.groupBy("component").agg(first), ["component"], "row")
    return found.withColumn("component_id", F.col("first.own_id")).withColumn("kept", F.col("row") == F.col("first.row")).drop("first", "component")
