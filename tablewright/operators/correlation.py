"""Pairwise-complete Pearson correlation: one scan for all pairs.

A few complete columns are summed in generated code. Wider tables, and tables
with gaps, would need thousands of aggregates there; their co-moments are
matrix products over Arrow batches instead, one small matrix per task.
Beyond ``WIDE`` columns the matrix is cut into blocks: a task holds the sums of
one pair of blocks, sums are added by cell, and the coefficients stay a table
that is read row by row or ranked where it lies.
Pairs whose spread is lost in the rounding of the sums are computed again
with Spark's one-pass covariance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import number, small_frame
from tablewright.session import cut_lineage

NARROW = 12
RECHECK_PER_SCAN = 6
# More columns than this are not gathered as one matrix.
WIDE = 256
# Columns in a block: the six sums of two blocks are 12 MB in a task.
BLOCK = 512
# Rows a task should see for each column: keeps the emitted cells a fraction of what is read.
ROWS_PER_COLUMN = 16
# Spread relative to the distance from the column mean below which sums are not trusted.
LOST = 1e-9
PAIR_SCHEMA = "index_a int, index_b int, column_a string, column_b string, r double"


def column_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Row count, non-null count, mean and extremes per column."""
    out = {}
    for start in range(0, len(columns), 100):
        batch = columns[start : start + 100]
        aggs = [F.count("*").alias("rows")]
        for i, c in enumerate(batch):
            v = number(df, c)
            aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"avg{i}")]
            aggs += [F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(batch):
            out[c] = {k: row[f"{k}{i}"] for k in ("n", "avg", "min", "max")} | {"rows": row["rows"]}
    return out


def coefficients(
    df: DataFrame, columns: list[str], facts: dict[str, dict] | None = None
) -> dict[tuple[str, str], float]:
    """r for every pair in column order (own pair included); undefined r is 0."""
    facts = facts or column_facts(df, columns)
    if len(columns) > WIDE:
        return {(r["column_a"], r["column_b"]): r["r"] for r in tiled(df, columns, facts).toLocalIterator()}
    varied = [c for c in columns if facts[c]["n"] and facts[c]["min"] != facts[c]["max"]]
    found, doubtful = {}, []
    if varied:
        complete = all(facts[c]["n"] == facts[c]["rows"] for c in varied)
        centers = [facts[c]["avg"] for c in varied]
        sums = _summed if complete and len(varied) <= NARROW else _multiplied
        for pair, m in sums(df, varied, centers).items():
            r = _coefficient(*m)
            if r is None:
                doubtful.append(pair)
            else:
                found[varied[pair[0]], varied[pair[1]]] = r
        for (i, j), r in _one_pass(df, varied, doubtful).items():
            found[varied[i], varied[j]] = r
    return {
        (a, b): found.get((a, b), 0.0) for i, a in enumerate(columns) for b in columns[i:]
    }


def _coefficient(n, sx, sy, sxx, syy, sxy) -> float | None:
    """r from centred sums over the common rows; None where rounding ate the spread."""
    if n < 2:
        return 0.0
    vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
    if vx <= LOST * sxx / n or vy <= LOST * syy / n:
        return None
    return (sxy / n - sx / n * sy / n) / (vx**0.5 * vy**0.5)


def _summed(df, columns, centers):
    values = df.select(
        *[(number(df, c) - F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(columns, centers))]
    )
    size = range(len(columns))
    wanted = [(i, j) for i in size for j in size if i <= j]
    row = values.agg(
        F.count("*").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in size],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in wanted],
    ).first()
    return {
        (i, j): (
            row["n"], row[f"s{i}"], row[f"s{j}"], row[f"p{i}_{i}"], row[f"p{j}_{j}"], row[f"p{i}_{j}"],
        )
        for i, j in wanted
    }


def _multiplied(df, columns, centers):
    width = len(columns)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((4, width, width))
        for batch in batches:
            x = np.column_stack(
                [c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]
            )
            present = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x - centers, nan=0.0)
            totals[0] += present.T @ present
            totals[1] += x.T @ present
            totals[2] += (x * x).T @ present
            totals[3] += x.T @ x
        cells = totals.reshape(4, width * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width, dtype="int32")), *[pa.array(t) for t in cells]],
            names=["cell", "n", "s", "q", "p"],
        )

    values = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    # Every task emits width² sums, which are dealt by cell: no task adds up more than its cells.
    cells = (
        values.mapInArrow(multiply, "cell int, n double, s double, q double, p double")
        .groupBy("cell")
        .agg(*[F.sum(k).alias(k) for k in ("n", "s", "q", "p")])
        .collect()
    )
    at = {divmod(c["cell"], width): c for c in cells}
    return {
        (i, j): (
            at[i, j]["n"], at[i, j]["s"], at[j, i]["s"], at[i, j]["q"], at[j, i]["q"], at[i, j]["p"],
        )
        for i in range(width)
        for j in range(i, width)
        if at
    }


def tiled(
    df: DataFrame, columns: list[str], facts: dict[str, dict] | None = None, block: int = BLOCK
) -> DataFrame:
    """What ``pairs`` gives, computed by pairs of column blocks and never gathered.

    Every pair of blocks reads its own columns only. Doubtful pairs are looked up first: they are
    few, and Spark's one-pass covariance decides them.
    """
    spark = df.sparkSession
    facts = facts or column_facts(df, columns)
    varied = [i for i, c in enumerate(columns) if facts[c]["n"] and facts[c]["min"] != facts[c]["max"]]
    ids = spark.range(len(columns)).select(F.col("id").cast("int").alias("index_a"))
    every = ids.select("index_a", F.explode(F.sequence("index_a", F.lit(len(columns) - 1))).alias("index_b"))
    if varied:
        sums = _block_sums(df, columns, varied, facts, block)
        # Every later use reads the cells again, so they are written once.
        found = cut_lineage(sums.select("index_a", "index_b", _ratio().alias("r")))
        doubtful = [(r["index_a"], r["index_b"]) for r in found.where("r IS NULL").collect()]
        again = [(*pair, r) for pair, r in _one_pass(df, columns, doubtful).items()]
        certain = found.where("r IS NOT NULL")
        if again:
            certain = certain.unionByName(small_frame(spark, again, "index_a int, index_b int, r double"))
        every = every.join(certain, ["index_a", "index_b"], "left")
    else:
        every = every.withColumn("r", F.lit(None).cast("double"))
    # One row per column of the table.
    names = F.broadcast(small_frame(spark, list(enumerate(columns)), "place int, name string"))
    for side in "ab":
        own = names.select(F.col("place").alias(f"index_{side}"), F.col("name").alias(f"column_{side}"))
        every = every.join(own, f"index_{side}")
    return every.select(
        "index_a", "index_b", "column_a", "column_b", F.coalesce("r", F.lit(0.0)).alias("r")
    )


def _ratio():
    """r from the sums of a cell, as ``_coefficient`` has it; null where it is doubtful."""
    n = F.when(F.col("n") > 0, F.col("n"))
    vx = F.col("qa") / n - (F.col("sa") / n) * (F.col("sa") / n)
    vy = F.col("qb") / n - (F.col("sb") / n) * (F.col("sb") / n)
    lost = (vx <= LOST * F.col("qa") / n) | (vy <= LOST * F.col("qb") / n)
    r = (F.col("p") / n - F.col("sa") / n * F.col("sb") / n) / (F.sqrt(vx) * F.sqrt(vy))
    return F.when(F.col("n") < 2, F.lit(0.0)).when(~lost, r)


_SUMS = ("n", "sa", "sb", "qa", "qb", "p")


def _block_sums(df, columns, varied, facts, block):
    """(index_a, index_b, sums over rows that have both), one scan per pair of blocks."""
    rows = next(iter(facts.values()))["rows"]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, rows // (ROWS_PER_COLUMN * len(varied)))
    blocks = [varied[k : k + block] for k in range(0, len(varied), block)]
    parts = []
    for i, a in enumerate(blocks):
        for b in blocks[i:]:
            own = a if a is b else a + b
            values = df.select(*[number(df, columns[k]).alias(f"x{k}") for k in own]).coalesce(tasks)
            centers = np.array([facts[columns[k]]["avg"] for k in own])
            schema = "index_a int, index_b int, " + ", ".join(f"{s} double" for s in _SUMS)
            parts.append(values.mapInArrow(_block_product(a, b, centers), schema))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    return cells.groupBy("index_a", "index_b").agg(*[F.sum(s).alias(s) for s in _SUMS])


def _block_product(a, b, centers):
    same = a == b

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(_SUMS), len(a), len(b)))
        seen = False
        # Slices of about 8 MB of doubles: a batch of a thousand columns is copied in parts.
        step = max(1, (1 << 20) // (len(a) + len(b)))
        for batch in (whole.slice(k, step) for whole in batches for k in range(0, whole.num_rows, step)):
            seen = True
            x = np.column_stack(
                [c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]
            )
            has = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x - centers, nan=0.0)
            xa, ha = x[:, : len(a)], has[:, : len(a)]
            xb, hb = (xa, ha) if same else (x[:, len(a) :], has[:, len(a) :])
            for k, (left, right) in enumerate(
                ((ha, hb), (xa, hb), (ha, xb), (xa * xa, hb), (ha, xb * xb), (xa, xb))
            ):
                totals[k] += left.T @ right
        for k, place in enumerate(a if seen else ()):  # a row of the block at a time
            first = k if same else 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(b) - first, place, "int32")),
                    pa.array(np.array(b[first:], "int32")),
                    *[pa.array(t[k, first:]) for t in totals],
                ],
                names=["index_a", "index_b", *_SUMS],
            )

    return multiply


def _one_pass(df, columns, wanted):
    out = {}
    for start in range(0, len(wanted), RECHECK_PER_SCAN):
        batch = wanted[start : start + RECHECK_PER_SCAN]
        aggs = []
        for k, (i, j) in enumerate(batch):
            x, y = number(df, columns[i]), number(df, columns[j])
            aggs += [
                F.covar_pop(x, y).alias(f"c{k}"),
                F.stddev_pop(F.when(y.isNotNull(), x)).alias(f"x{k}"),
                F.stddev_pop(F.when(x.isNotNull(), y)).alias(f"y{k}"),
            ]
        row = df.agg(*aggs).first()
        for k, pair in enumerate(batch):
            spread = (row[f"x{k}"] or 0.0) * (row[f"y{k}"] or 0.0)
            out[pair] = row[f"c{k}"] / spread if spread else 0.0
    return out


def pairs(df: DataFrame, columns: list[str], facts: dict[str, dict] | None = None) -> DataFrame:
    """(index_a, index_b, column_a, column_b, r) for index_a <= index_b."""
    if len(columns) > WIDE:
        return tiled(df, columns, facts)
    place = {c: i for i, c in enumerate(columns)}
    rows = [
        (place[a], place[b], a, b, r) for (a, b), r in coefficients(df, columns, facts).items()
    ]
    return small_frame(df.sparkSession, rows, PAIR_SCHEMA)


def matrix(
    df: DataFrame, columns: list[str], digits: int = 3, facts: dict[str, dict] | None = None
) -> DataFrame:
    """Full symmetric matrix as rows, rounded."""
    if len(columns) > WIDE:
        return mirrored(tiled(df, columns, facts), digits)
    place = {c: i for i, c in enumerate(columns)}
    rows = []
    for (a, b), r in coefficients(df, columns, facts).items():
        rows.append((place[a], place[b], a, b, round(r, digits)))
        if a != b:
            rows.append((place[b], place[a], b, a, round(r, digits)))
    return small_frame(df.sparkSession, rows, PAIR_SCHEMA)


def mirrored(half: DataFrame, digits: int) -> DataFrame:
    """Both halves of a matrix, rounded as Python's ``round`` does it, without gathering it."""

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [round(r, digits) for r in batch.column("r").to_pylist()]
            yield batch.set_column(4, "r", pa.array(values, pa.float64()))

    half = half.mapInArrow(rounded, PAIR_SCHEMA)
    other = half.where("index_a < index_b").select(
        F.col("index_b").alias("index_a"), F.col("index_a").alias("index_b"),
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r",
    )
    return half.unionByName(other)


def strongest(full: DataFrame) -> DataFrame:
    """(index_a, column_a, column_b, r): the largest |r| in each column, the earliest on ties.

    ``column_b`` is null where every r is 0.
    """
    best = F.max_by(F.struct("column_b", "r"), F.struct(F.abs("r"), -F.col("index_b")))
    rows = full.where("index_a <> index_b").groupBy("index_a", "column_a").agg(best.alias("best"))
    return rows.select(
        "index_a", "column_a",
        F.when(F.col("best.r") != 0, F.col("best.column_b")).alias("column_b"), "best.r",
    )


def ranked_pairs(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Strongest pairs of different columns by |r|."""
    return (
        pairs(df, columns)
        .where("index_a < index_b")
        .orderBy(F.desc(F.abs("r")), "index_a", "index_b")
        .limit(top)
    )
