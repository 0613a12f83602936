"""Shards by a k-d tree over metadata, cut at distributed weighted medians.

A node that holds n shards is cut along its widest metadata dimension at the weight that leaves
n // 2 shards' worth of bytes below. The cut is found by histograms of the node's keys that are
narrowed round by round, for all nodes of a level at once; only one row per node reaches the
driver. Keys are a dimension's value followed by a hash, so a value that holds a third of all
rows is cut like any other. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

# A key: 15 bits of the value, 31 of a hash of the row, 16 of its place among equals.
VALUE_BITS, TIE_BITS = 15, 47


@dataclass(frozen=True)
class TreePlan:
    """``bins`` per histogram; a cut is good enough within ``tolerance`` of a shard's bytes."""

    shards: int = 40
    bins: int = 2048
    tolerance: float = 0.0005
    slot_rows: int = 20_000


def category(column: str) -> Column:
    """A text column as a dimension: its hash; null is a value of its own."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("\0null"))), F.lit(1 << VALUE_BITS))


def magnitude(value: Column) -> Column:
    """A size as a dimension, on a logarithmic scale; null and negative are zero."""
    number = F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(F.log2(number + 1) * 512), F.lit((1 << VALUE_BITS) - 1)).cast("long")


def shard(docs: DataFrame, dimensions: dict[str, Column], plan: TreePlan = TreePlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Size is the text's UTF-8 bytes plus 16; null text has none. Shards get nearly equal bytes
    (the law ``bytes``: a shard is off by the cuts' tolerance or a single long text at most).
    Slots count a shard's rows from 0 without gaps. Repeated rows are rows of their own; with
    fewer rows than shards some shards stay empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[c.cast("long").alias(f"d{k}") for k, c in enumerate(dimensions.values())],
    )
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16))
    tie = F.shiftleft(F.pmod(F.xxhash64("id", "text_crc32"), F.lit(1 << 31)), 16) + place
    base = cut_lineage(base.withColumn("tie", tie))
    names = [f"d{k}" for k in range(len(dimensions))]
    tree = base.withColumn("node", F.lit(0))
    leaves = {0: plan.shards}
    whole = base.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[F.min(n).alias(f"a_{n}") for n in names], *[F.max(n).alias(f"b_{n}") for n in names]).first()
    if whole.bytes is None:
        return _placed(tree, plan, 1, id_col)
    enough = plan.tolerance * whole.bytes / plan.shards
    while any(n > 1 for n in leaves.values()):
        cuts = _cuts(spark, tree, leaves, names, whole, enough, plan)
        table = _inline(spark, "node int, axis int, cut long, right int", [(c.node, c.axis, c.cut, c.node + leaves[c.node] // 2) for c in cuts])
        keyed = tree.join(F.broadcast(table), "node", "left")
        tree = keyed.withColumn("node", F.when(_key(names) >= F.col("cut"), F.col("right")).otherwise(F.col("node"))).drop("axis", "cut", "right")
        leaves = {at: n for node, k in leaves.items() for at, n in (((node, k // 2), (node + k // 2, k - k // 2)) if k > 1 else ((node, k),))}
    return _placed(tree, plan, whole.n, id_col)


@dataclass
class _Cut:
    node: int
    axis: int
    low: int
    width: int
    target: float
    below: float = 0.0
    cut: int | None = None


def _key(names: list[str]) -> Column:
    """The row's key along its node's axis."""
    value = F.coalesce(*[F.when(F.col("axis") == k, F.col(n)) for k, n in enumerate(names)])
    return F.shiftleft(value, TIE_BITS) + F.col("tie")


def _cuts(spark: SparkSession, tree: DataFrame, leaves: dict[int, int], names: list[str], whole, enough: float, plan: TreePlan) -> list[_Cut]:
    spreads = [F.max(n) - F.min(n) for n in names]
    facts = tree.groupBy("node").agg(F.sum("size").alias("bytes"), *[F.min(n).alias(f"a_{n}") for n in names], *[s.alias(f"s_{n}") for s, n in zip(spreads, names, strict=True)]).collect()
    open_cuts, done = [], []
    for r in facts:
        if leaves[r.node] == 1:
            continue
        share = [r[f"s_{n}"] / max(1, whole[f"b_{n}"] - whole[f"a_{n}"]) for n in names]
        axis = max(range(len(names)), key=lambda k: (share[k], -k))
        low, span = r[f"a_{names[axis]}"] << TIE_BITS, (r[f"s_{names[axis]}"] + 1) << TIE_BITS
        target = r.bytes * (leaves[r.node] // 2) / leaves[r.node]
        open_cuts.append(_Cut(r.node, axis, low, -(-span // plan.bins), target))
    while open_cuts:
        table = _inline(spark, "node int, axis int, low long, width long, target double, below double", [(c.node, c.axis, c.low, c.width, c.target, c.below) for c in open_cuts])
        # Whole-number division: doubles would round keys of 62 bits.
        keyed = tree.join(F.broadcast(table), "node").withColumn("key", _key(names))
        keyed = keyed.withColumn("bin", F.expr("(key - low) div width"))
        inside = keyed.where((F.col("bin") >= 0) & (F.col("bin") < plan.bins))
        bins = inside.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.first("target").alias("target"), F.first("below").alias("below"))
        upto = F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        first = F.row_number().over(Window.partitionBy("node").orderBy("bin"))
        hits = bins.withColumn("upto", upto).where("upto >= target").withColumn("k", first).where("k = 1").collect()
        found = {r.node: r for r in hits}
        still = []
        for c in open_cuts:
            r = found[c.node]
            low, before = c.low + r.bin * c.width, r.upto - r.w
            if r.w <= enough or r.n == 1 or c.width == 1:
                # The whole bin goes to the side that comes closer.
                c.cut = low + c.width if r.upto - c.target <= c.target - before else low
                done.append(c)
            else:
                still.append(_Cut(c.node, c.axis, low, -(-c.width // plan.bins), c.target, before))
        open_cuts = still
    return done


def _inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of a few driver rows (at most one per shard) as SQL values."""
    fields = [f.split() for f in schema.split(", ")]
    values = ", ".join("(" + ", ".join(f"cast({v!r} as {kind})" for v, (_, kind) in zip(r, fields, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")


def _placed(tree: DataFrame, plan: TreePlan, rows: int, id_col: str) -> DataFrame:
    """Slots: buckets of a shard are numbered one after the other, rows inside each bucket."""
    buckets = max(16, -(-rows // (plan.shards * plan.slot_rows)))
    placed = cut_lineage(tree.select("id", "size", "text_crc32", "tie", F.col("node").cast("int").alias("shard"), F.pmod(F.xxhash64("tie"), F.lit(buckets)).cast("int").alias("bucket")))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = counts.select("shard", "bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "id")) - 1
    out = placed.withColumn("place", place).join(offsets, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
