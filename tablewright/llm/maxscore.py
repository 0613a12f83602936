"""Exact top-k inner products by MaxScore.

Components are the terms of a query. A shard (a block of candidates) keeps its postings by term
with the smallest and largest value of each, which bound what a term can add to any score. Given
the lowest score of the k found so far, terms are split: those that cannot lift a candidate above
it all together are non-essential. Essential postings are traversed for all candidates of a chunk,
the others are probed, largest bound first, only for candidates that are still competitive. The
best k of every shard are merged at the end.

Queries and candidates are dealt to blocks by hash, and each pair of blocks is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.vectors import finite, matrix, rows
from tablewright.session import cut_lineage


@dataclass(frozen=True)
class SearchPlan:
    """Sizes of blocks; ``least_blocks`` of each kind let small tables use several tasks."""

    k: int = 20
    scale: float = 64.0
    query_block: int = 16384
    shard: int = 16384
    least_blocks: int = 4
    chunk: int = 4096
    probe: int = 8


class Shard:
    """Postings of a block of candidates, values by term. Of equal scores the earlier candidate wins."""

    def __init__(self, names: np.ndarray, values: np.ndarray, chunk: int):
        self.names, self.chunk = names, chunk
        self.postings = np.ascontiguousarray(values.T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def top(self, own: int, weights: np.ndarray, k: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k candidates, without the one whose name is ``own``."""
        ends = np.stack([weights * self.low, weights * self.high])
        base, spread = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
        terms = np.argsort(-spread, kind="stable")
        # What the terms from each place on can add above their least values.
        rest = np.concatenate([np.cumsum(spread[terms][::-1])[::-1], [0]])
        least = base.sum()
        best_at, best = np.zeros(0, np.int64), np.zeros(0, weights.dtype)
        for at in range(0, len(self.names), self.chunk):
            postings = self.postings[:, at : at + self.chunk]
            names = self.names[at : at + self.chunk]
            bar = best[-1] if len(best) == k else None
            essential = len(terms) if bar is None else int(np.argmax(rest < bar - least)) if (rest < bar - least).any() else len(terms)
            used = terms[:essential]
            scores = weights[used] @ postings[used] - base[used].sum() if essential else np.zeros(len(names), weights.dtype)
            alive = np.flatnonzero(names != own)
            scores = scores[alive]
            while essential < len(terms) and len(alive):
                keep = np.flatnonzero(scores + rest[essential] >= bar - least)
                alive, scores = alive[keep], scores[keep]
                used = terms[essential : essential + probe]
                scores = scores + weights[used] @ postings[np.ix_(used, alive)] - base[used].sum()
                essential += len(used)
            scores = scores + least
            if bar is not None:
                keep = np.flatnonzero(scores > bar)  # an equal score comes later here
                alive, scores = alive[keep], scores[keep]
            if len(alive):
                both, places = np.concatenate([best, scores]), np.concatenate([best_at, alive + at])
                if len(both) > 4 * k:
                    cut = np.partition(both, len(both) - k)[len(both) - k]
                    both, places = both[both >= cut], places[both >= cut]
                order = np.lexsort((places, -both))[:k]
                best, best_at = both[order], places[order]
        return best_at, best


def _typed(values: np.ndarray, weights: np.ndarray) -> type:
    """The fastest type in which every partial sum of products is exact."""
    top = float(np.abs(values).max(initial=0)) * float(np.abs(weights).max(initial=0)) * max(values.shape[1], 1) * 4
    if top < 2**24:
        return np.float32
    if top < 2**53:
        return np.float64
    if top < 2**62:
        return np.int64
    raise ValueError("scores beyond 64 bits")


def search(vectors: DataFrame, is_query, plan: SearchPlan = SearchPlan(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The best ``k`` other rows for each row where ``is_query`` (a column of the table) holds.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the integer inner product of
    floor(scale * x). Vectors that are null or hold null or non-finite components take no part;
    a shorter vector is read as continued with zeros. A query with fewer than ``k`` other rows gets
    them all. Only the query's own row is no candidate: rows that repeat its id are, and two query
    rows with one id have a list each under that id. A row with a null id is a candidate without a
    name; among equal scores it comes after all ids, and equal ids go by an arbitrary row number.
    An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = [np.floor(v * plan.scale) for v in rows(batch.column(2))]
            if any(len(v) and np.abs(v).max() >= 2**53 for v in scaled):
                raise ValueError("components beyond 53 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.astype(np.int64).tobytes() for v in scaled], pa.binary())], ["id", "asks", "x"])

    usable = vectors.where(finite(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = cut_lineage(usable.mapInArrow(run, "id long, asks boolean, x binary").withColumn("row", F.monotonically_increasing_id()))
    sizes = usable.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards = max(plan.least_blocks, -(-sizes.n // plan.shard))
    query_blocks = max(plan.least_blocks, -(-sizes.q // plan.query_block))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Nulls would make a column of ids one of doubles in pandas.
    known = ["row", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("missing"), "x"]
    asked = usable.where("asks").select(*known, F.lit(True).alias("is_query"), deal(11, query_blocks).alias("q"), each(shards).alias("s"))
    offered = usable.select(*known, F.lit(False).alias("is_query"), each(query_blocks).alias("q"), deal(13, shards).alias("s"))

    found_columns = ["query_row", "query_id", "no_query_id", "row", "id", "missing", "score"]

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["is_query"].to_numpy(bool)
        queries, offers = pdf[asks], pdf[~asks].sort_values(["missing", "id", "row"])
        found = []
        if len(queries) and len(offers):
            weights, values = matrix(queries["x"], np.int64), matrix(offers["x"], np.int64)
            width = max(weights.shape[1], values.shape[1])
            weights, values = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (weights, values))
            kind = _typed(values, weights)
            names, ids, missing = (offers[c].to_numpy() for c in ("row", "id", "missing"))
            shard = Shard(names, values.astype(kind), plan.chunk)
            for row, id_, none, own in zip(queries["row"], queries["id"], queries["missing"], weights.astype(kind), strict=True):
                at, scores = shard.top(row, own, plan.k, plan.probe)
                found.append(pd.DataFrame({"query_row": row, "query_id": id_, "no_query_id": none, "row": names[at], "id": ids[at], "missing": missing[at], "score": scores.astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in found_columns})

    schema = "query_row long, query_id long, no_query_id boolean, row long, id long, missing boolean, score long"
    shard_best = asked.unionByName(offered).groupBy("q", "s").applyInPandas(best, schema)
    # At most k rows from each shard meet in a query's group.
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "missing", "id", "row")
    ranked = shard_best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= plan.k)
    unless = lambda missing, c: F.when(~F.col(missing), F.col(c))
    return ranked.select(unless("no_query_id", "query_id").alias("query_id"), "rank", unless("missing", "id").alias("vec_id"), "score")
