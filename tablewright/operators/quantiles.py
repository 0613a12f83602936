"""Exact quantiles that never hold a whole column in one task.

``percentile`` keeps every distinct value of its input in a single buffer. It
is used only where a count proves that buffer small. Beyond that, the wanted
order statistics are closed in on by rank: a sketch proposes two pivots, one
aggregate counts the rows around them, and the search continues strictly
between pivots. Only aggregate buffers move; rows are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import clean_value, number
from tablewright.operators import ordered

# Distinct doubles one aggregation buffer may hold (tens of megabytes).
BUFFER_VALUES = 1_000_000
SKETCH_ACCURACY = 10_000
# Columns searched by rank in one aggregate.
SEARCHED_PER_SCAN = 16


@dataclass
class _Search:
    """One wanted rank: values strictly inside (low, high) are still candidates."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    distinct: int | None = None
    value: float | None = None

    def within(self, v: Column, low=..., high=...) -> Column:
        low = self.low if low is ... else low
        high = self.high if high is ... else high
        keep = v.isNotNull()
        if low is not None:
            keep = keep & (v > F.lit(low))
        if high is not None:
            keep = keep & (v < F.lit(high))
        return keep


def counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Non-null values per column."""
    row = df.agg(*[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(columns)}


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    exact: bool = True,
    sizes: dict[str, int] | None = None,
    buffer_values: int = BUFFER_VALUES,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, as driver values (columns × probs)."""
    if not columns:
        return {}
    if exact and sizes is None:
        sizes = counts(df, columns)
    small = [c for c in columns if not exact or sizes[c] <= buffer_values]
    found = {}
    for batch in _batches(small, sizes if exact else {}, 2 * buffer_values):
        found.update(_one_pass(df, batch, probs, exact))
    large = [c for c in columns if c not in found]
    for start in range(0, len(large), SEARCHED_PER_SCAN):
        batch = large[start : start + SEARCHED_PER_SCAN]
        found.update(_by_rank(df, batch, probs, sizes, buffer_values))
    return found


def _batches(columns, sizes, most):
    """Columns whose buffers, together in one task, stay within ``most`` values."""
    batch, held = [], 0
    for c in columns:
        if batch and (held + sizes.get(c, 0) > most or len(batch) == 100):
            yield batch
            batch, held = [], 0
        batch.append(c)
        held += sizes.get(c, 0)
    if batch:
        yield batch


def _one_pass(df, columns, probs, exact):
    levels = F.array(*[F.lit(float(p)) for p in probs])
    aggs = []
    for i, c in enumerate(columns):
        v = number(df, c)
        q = F.percentile(v, levels) if exact else F.percentile_approx(v, levels, SKETCH_ACCURACY)
        aggs.append(q.alias(f"q{i}"))
    row = df.agg(*aggs).first()
    return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}


def _by_rank(df, columns, probs, sizes, buffer_values):
    searches: dict[tuple[str, int], _Search] = {}
    for c in columns:
        for p in probs:
            position = p * (sizes[c] - 1)
            for rank in {math.floor(position), math.ceil(position)}:
                searches.setdefault((c, rank), _Search(c, rank, sizes[c]))
    while True:
        open_ = [s for s in searches.values() if s.value is None]
        wide = [s for s in open_ if (s.distinct or s.inside) > buffer_values]
        if not wide:
            break
        _narrow(df, wide)
    _finish(df, open_)
    result = {}
    for c in columns:
        values = []
        for p in probs:
            position = p * (sizes[c] - 1)
            lower = searches[c, math.floor(position)].value
            upper = searches[c, math.ceil(position)].value
            values.append(lower + (upper - lower) * (position - math.floor(position)))
        result[c] = values
    return result


def _pivots(df, searches) -> list[tuple[float, float]]:
    """Two values around each rank; searches of one interval share a sketch."""
    slack = 2.0 / SKETCH_ACCURACY
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(searches):
        shared.setdefault((s.column, s.low, s.high), []).append(i)
    sketches = []
    for g, members in enumerate(shared.values()):
        levels = []
        for i in members:
            p = (searches[i].rank + 0.5) / searches[i].inside
            levels += [F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack))]
        s = searches[members[0]]
        v = number(df, s.column)
        inner = F.when(s.within(v), v)
        sketches.append(F.percentile_approx(inner, F.array(*levels), SKETCH_ACCURACY).alias(f"p{g}"))
    row = df.agg(*sketches).first()
    out = {}
    for g, members in enumerate(shared.values()):
        for at, i in enumerate(members):
            out[i] = tuple(row[f"p{g}"][2 * at : 2 * at + 2])
    return [out[i] for i in range(len(searches))]


def _narrow(df, searches):
    """Two aggregates: pivots around each rank, then the counts beside them."""
    pivots = _pivots(df, searches)
    tallies = []
    for i, s in enumerate(searches):
        v = number(df, s.column)
        a, b = pivots[i]
        middle = s.within(v, low=a, high=b)
        tallies += [
            F.count_if(s.within(v, high=a)).alias(f"below{i}"),
            F.count_if(v == F.lit(a)).alias(f"a{i}"),
            F.count_if(middle).alias(f"mid{i}"),
            F.approx_count_distinct(F.when(middle, v)).alias(f"d{i}"),
            F.count_if(v == F.lit(b)).alias(f"b{i}"),
        ]
    row = df.agg(*tallies).first()
    for i, s in enumerate(searches):
        a, b = pivots[i]
        below, at_a, mid, at_b = (row[f"{k}{i}"] for k in ("below", "a", "mid", "b"))
        if a == b:
            mid = at_b = 0
        if s.rank < below:
            s.high, s.inside, s.distinct = a, below, None
            continue
        s.rank -= below
        if s.rank < at_a:
            s.value = a
            continue
        s.rank -= at_a
        if s.rank < mid:
            s.low, s.high, s.inside, s.distinct = a, b, mid, row[f"d{i}"]
            continue
        s.rank -= mid
        if s.rank < at_b:
            s.value = b
            continue
        s.rank -= at_b
        s.low, s.inside, s.distinct = b, s.inside - below - at_a - mid - at_b, None


def _finish(df, searches):
    """The few candidates left around each rank fit one buffer: read the value off."""
    if not searches:
        return
    kept, aggs = [], []
    for i, s in enumerate(searches):
        v = number(df, s.column)
        kept.append(F.when(s.within(v), v).alias(f"v{i}"))
        level = (s.rank + 0.5) / s.inside
        aggs.append(F.expr(f"percentile_disc({level!r}D) within group (order by v{i})").alias(f"f{i}"))
    row = df.select(*kept).agg(*aggs).first()
    for i, s in enumerate(searches):
        s.value = row[f"f{i}"]


def group_medians(
    df: DataFrame, by: str, value: str, name: str = "value", buffer_values: int = BUFFER_VALUES
) -> DataFrame:
    """Median of ``value`` per non-null ``by``; groups without values are left out."""
    data = df.select(clean_value(df, by).alias("k"), number(df, value).alias("v")).where(
        "k is not null and v is not null"
    )
    if data.count() <= buffer_values:
        out = data.groupBy("k").agg(F.median("v").alias(name))
    else:
        out = _spread_medians(data, name, buffer_values)
    return out.withColumnRenamed("k", by)


def _spread_medians(data: DataFrame, name: str, buffer_values: int) -> DataFrame:
    """Medians when a single group may be larger than any task should hold.

    Equal (group, value) rows collapse first. Each group is cut into value
    buckets; the bucket sizes tell which one or two buckets hold the middle
    ranks, and only those buckets are sorted.
    """
    tally = data.groupBy("k", "v").agg(F.count("*").alias("n"))
    tally = ordered.with_bucket(tally, ["v"], buffer_values, sampled_from=data, tie=["k"]).drop(ordered.TIE)
    by_bucket = tally.groupBy("k", "bucket").agg(F.sum("n").alias("m"))
    per_key = Window.partitionBy("k")
    running = per_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        by_bucket.withColumn("before", F.coalesce(F.sum("m").over(running), F.lit(0)))
        .withColumn("size", F.sum("m").over(per_key))
        .withColumn("first_rank", F.floor((F.col("size") - 1) / 2))
        .withColumn("last_rank", F.ceil((F.col("size") - 1) / 2))
        .where("before <= last_rank and before + m > first_rank")
        .select("k", "bucket", "before", "first_rank", "last_rank")
    )
    inner = (
        Window.partitionBy("k", "bucket")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = tally.join(wanted, ["k", "bucket"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(inner)
    )
    covers = lambda rank: (F.col(rank) < F.col("upto")) & (
        F.col(rank) >= F.col("upto") - F.col("n")
    )
    return located.groupBy("k").agg(
        (
            (
                F.max(F.when(covers("first_rank"), F.col("v")))
                + F.max(F.when(covers("last_rank"), F.col("v")))
            )
            / 2
        ).alias(name)
    )
