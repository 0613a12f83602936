"""Near-duplicate vectors by products of int8 tiles with rigorous error bounds.

Each unit vector is rounded to int8 with a scale of its own, and the length of what rounding took
away is kept. For x = q + e and y = p + f the product differs from q.p by at most
|e||p| + |f||q| + |e||f|, so one exact integer product per tile decides almost every pair; pairs
whose bounds enclose the threshold are computed again in double precision.

Equal vectors are one class from the start. Vectors are dealt to cells by their nearest pivot (a
bounded sample), and two cells meet only if their pivots' angle, less both cells' radii, leaves
room for a link. From a tile leave only sums per vector and one link per vector to its smallest
member in the tile's component, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import graph
from tablewright.llm.vectors import finite, matrix, rows
from tablewright.session import cut_lineage


@dataclass(frozen=True)
class LinkPlan:
    """``block`` vectors make a tile's side; at most ``pivots`` cells, from a hash sample."""

    threshold: float = 0.95
    block: int = 16384
    pivots: int = 256
    chunk: int = 512


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8, their scales, and bounds of the length of the rounding error."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error * (1 + 1e-9) + 1e-12


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: single precision holds every sum over 1,024 components."""
    out = None
    for k in range(0, max(a.shape[1], 1), 1024):
        part = a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of x, j of y) with a cosine of at least the threshold; y None: within x, i < j."""
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    xu = unit(x)
    yu = xu if y is None else unit(y)
    qx, sx, ex = quantize(xu)
    qy, sy, ey = (qx, sx, ex) if y is None else quantize(yu)
    worst = float(ey.max(initial=0.0))
    left, right = [], []
    for at in range(0, len(x), chunk):
        rows_ = slice(at, at + chunk)
        product = _products(qx[rows_], qy)
        product *= sy.astype(product.dtype)
        # |q| is at most 1 + |e|; the last term covers single-precision scaling.
        slack = lambda e, f: e * (1 + f) + f * (1 + e) + e * f + 2e-6
        floor = (threshold - slack(ex[rows_], worst)) / sx[rows_]
        i, j = np.nonzero(product >= floor[:, None].astype(product.dtype) * (1 - 1e-6))
        if y is None:
            later = j > i + at
            i, j = i[later], j[later]
        near = product[i, j].astype(np.float64) * sx[rows_][i]
        room = slack(ex[rows_][i], ey[j])
        i = i + at
        unsure = np.flatnonzero(np.abs(near - threshold) <= room)
        keep = near - threshold > room
        for k in range(0, len(unsure), 1 << 16):
            part = unsure[k : k + (1 << 16)]
            keep[part] = _cosines(x[i[part]], (x if y is None else y)[j[part]]) >= threshold
        left.append(i[keep])
        right.append(j[keep])
    empty = np.zeros(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """All rows, numbered: ``row``, ``id``, the vector as packed doubles scaled by their largest
    component (null if it is unusable), and a 128-bit name of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(v / top).tobytes() if len(v) and (top := np.abs(v).max()) > 0 else None for v in rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "x"])

    nothing = F.array().cast("array<double>")
    usable = F.when(finite(vector_col), F.col(vector_col).cast("array<double>")).otherwise(nothing)
    packed = vectors.select(F.col(id_col).cast("long").alias("id"), usable.alias("v")).mapInArrow(run, "id long, x binary")
    return packed.withColumn("row", F.monotonically_increasing_id()).withColumn("name_a", F.xxhash64("x")).withColumn("name_b", F.xxhash64(F.lit(1), "x"))


def _pivots(classes: DataFrame, count: int, plan: LinkPlan) -> np.ndarray:
    wanted = max(1, min(plan.pivots, -(-count // plan.block)))
    picked = classes.orderBy(F.xxhash64(F.lit(3), "rep"), "rep").limit(wanted).select("x").collect()
    x = matrix([r.x for r in picked], np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dealt(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Cell (nearest pivot) of each class, and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix([v.as_buffer() for v in batch.column(1)], np.float64)
            if len(x):
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            width = max(x.shape[1], pivots.shape[1])
            wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
            cosine = wide(x) @ wide(pivots).T
            cell = cosine.argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(cosine[np.arange(len(x)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell, pa.int32()), pa.array(angle)], ["rep", "x", "copies", "cell", "angle"])

    return classes.select("rep", "x", "copies").mapInArrow(run, "rep long, x binary, copies long, cell int, angle double")


def _meetings(dealt: DataFrame, pivots: np.ndarray, plan: LinkPlan) -> list[tuple[int, int, int, int]]:
    """For each pair of cells that can hold a link: (cell, partner, own blocks, partner's blocks)."""
    cells = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("rep").alias("n"), F.max("angle").alias("radius")).collect()}
    blocks = {c: max(1, math.ceil(r.n / plan.block)) for c, r in cells.items()}
    reach = math.acos(max(-1.0, min(1.0, plan.threshold))) + 1e-6
    out = []
    for a in cells:
        for b in cells:
            apart = math.acos(max(-1.0, min(1.0, float(pivots[a] @ pivots[b])))) - cells[a].radius - cells[b].radius
            if a == b or apart <= reach:
                out.append((a, b, blocks[a], blocks[b]))
    return out


def links(vectors: DataFrame, plan: LinkPlan = LinkPlan(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    A shorter vector is read as continued with zeros. Equal vectors are linked with each other.
    Rows whose id is null or repeated are rows like all others, with their own vectors: the
    component is the smallest id that links reach, null if none of its rows has one, and one row
    of each component is kept, the first with that id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    packed = cut_lineage(_packed(vectors, id_col, vector_col))
    usable = packed.where(F.col("x").isNotNull())
    classes = cut_lineage(usable.groupBy("name_a", "name_b").agg(F.min("row").alias("rep"), F.first("x").alias("x"), F.count("*").alias("copies")))
    count = classes.count()
    alone = packed.where(F.col("x").isNull()).select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("row").alias("component"))
    if count == 0:
        return _by_id(alone, id_col)
    pivots = _pivots(classes, count, plan)
    dealt = cut_lineage(_dealt(classes, pivots))
    meetings = spark.createDataFrame(_meetings(dealt, pivots, plan), "cell int, partner int, own_blocks int, partner_blocks int")
    # At most pivots squared rows of four integers: 1 MB.
    met = dealt.join(F.broadcast(meetings), "cell")
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("own_blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("partner_blocks") - 1)))
    mine, theirs = F.struct("cell", "own"), F.struct(F.col("partner").alias("cell"), F.col("other").alias("own"))
    met = met.select(
        "rep", "x", "copies",
        F.least(mine, theirs).alias("low"), F.greatest(mine, theirs).alias("high"), (mine <= theirs).alias("is_low"),
    ).select("rep", "x", "copies", "is_low", F.col("low.cell").alias("c1"), F.col("low.own").alias("b1"), F.col("high.cell").alias("c2"), F.col("high.own").alias("b2"))
    threshold, chunk = plan.threshold, plan.chunk

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, reps, copies = matrix(pdf["x"], np.float64), pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        one = pdf["c1"].iloc[0] == pdf["c2"].iloc[0] and pdf["b1"].iloc[0] == pdf["b2"].iloc[0]
        order = np.lexsort((reps, ~pdf["is_low"].to_numpy(bool)))
        x, reps, copies = x[order], reps[order], copies[order]
        split = len(reps) if one else int(pdf["is_low"].sum())
        i, j = tile_links(x, None, threshold, chunk) if one else tile_links(x[:split], x[split:], threshold, chunk)
        j = j if one else j + split
        weight = np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))
        rank = np.argsort(np.argsort(reps))  # smallest member by id, not by place
        roots = np.sort(reps)[local_roots(len(reps), rank[i], rank[j])[rank]]
        found = np.flatnonzero(weight > 0)
        return pd.DataFrame({"rep": reps[found], "links": weight[found].astype(np.int64), "root": roots[found]})

    tiles = cut_lineage(met.groupBy("c1", "b1", "c2", "b2").applyInPandas(compare, "rep long, links long, root long"))
    sums = tiles.groupBy("rep").agg(F.sum("links").alias("links"))
    found = graph.components(tiles.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("rep", "name_a", "name_b", "copies").join(sums, "rep", "left")
    named = cut_lineage(named.join(found, F.col("rep") == F.col("node"), "left").select("name_a", "name_b", "copies", "links", F.coalesce("component", "rep").alias("component")))
    members = usable.select("row", "id", "name_a", "name_b").join(named, ["name_a", "name_b"])
    members = members.select("row", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    return _by_id(members.unionByName(alone), id_col)


def _by_id(found: DataFrame, id_col: str) -> DataFrame:
    placed = cut_lineage(found.withColumnRenamed("id", "own_id"))
    return graph.named(placed).select(F.col("own_id").alias(id_col), "n_links", "component_id", "kept")
