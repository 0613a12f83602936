"""Order-dependent operators without a global single-task window.

Rows are cut into consecutive key ranges ("buckets") by boundaries sampled
once. Rows with equal keys are told apart by a hash of the row, so that a key
held by a third of all rows is many buckets too. A window then runs inside each
bucket, and what has to cross a border is one carried value per bucket, that is
one for every ``ROWS_PER_BUCKET`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import clean_value, ref, small_frame
from tablewright.session import cut_lineage

ROWS_PER_BUCKET = 2_000_000
# Rows that are sorted and numbered together.
ROWS_PER_RANGE = 500_000
SAMPLE_PER_BUCKET = 40
# Keys that the boundaries are chosen from, at most. More buckets have fewer samples each and are
# less even; results never depend on where a boundary lies.
SAMPLE_KEYS = 400_000
TIE = "__tie"
# Up to this many rows a top-k runs directly.
DIRECT_ROWS = 5_000_000
NARROWING_SAMPLE = 2_000


def order_key(order_by: list[str]) -> Column:
    """The ordering columns as one comparable value."""
    if len(order_by) == 1:
        return ref(order_by[0])
    return F.struct(*[ref(c) for c in order_by])


def _hashable(dtype: T.DataType) -> bool:
    return "map<" not in dtype.simpleString() and "variant" not in dtype.simpleString()


def with_tie(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``TIE``, a hash of the row (or of some columns): the order among equal keys."""
    chosen = columns or [f.name for f in df.schema.fields if _hashable(f.dataType)]
    return df.withColumn(TIE, F.xxhash64(*[ref(c) for c in chosen]))


def _split_key(order_by: list[str]) -> Column:
    """Ordering columns and tie as one comparable value; nulls come first in it."""
    return F.struct(*[ref(c).alias(f"k{i}") for i, c in enumerate(order_by)], F.col(TIE))


def boundaries(df: DataFrame, order_by: list[str], rows_per_bucket: int) -> DataFrame | None:
    """One row with ``cuts``, an increasing array of keys that cut the rows into even ranges.

    ``df`` has ties. None if one range is enough.
    """
    total = df.count()
    buckets = -(-total // rows_per_bucket)
    if buckets <= 1:
        return None
    wanted = min(SAMPLE_PER_BUCKET * buckets, SAMPLE_KEYS)
    keys = df.select(_split_key(order_by).alias("key"))
    sample = keys.sample(min(1.0, wanted * 1.5 / total), seed=V.SAMPLE_SEED)
    # At most SAMPLE_KEYS and a half keys meet here; they never reach the driver.
    found = sample.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    places = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: (F.size("keys") * i / buckets).cast("int"))
    cuts = F.array_distinct(F.transform(places, lambda at: F.get("keys", at)))
    return found.select(F.when(F.size("keys") > 0, cuts).otherwise(F.slice("keys", 1, 0)).alias("cuts"))


def bucket_of(key: Column, cuts: Column, size: int) -> Column:
    """Index of the range ``key`` falls in: a binary search in an array of cuts."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(size.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= size) & (F.try_element_at(cuts, F.least(low + step, F.lit(size))) <= key),
            low + step,
        ).otherwise(low),
    )


def with_bucket(
    df: DataFrame,
    order_by: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    sampled_from: DataFrame | None = None,
    tie: list[str] | None = None,
) -> DataFrame:
    """Add ``bucket``: 0, 1, … in key order, and ``TIE``, the order among equal keys.

    ``tie`` names the columns that tell rows with equal keys apart (all by default). Only rows that
    are equal in all of them always share a bucket.
    """
    tied = with_tie(df, tie)
    made = boundaries(tied if sampled_from is None else with_tie(sampled_from, tie), order_by, rows_per_bucket)
    if made is None:
        return tied.withColumn("bucket", F.lit(0))
    made = cut_lineage(made)
    size = made.select(F.size("cuts").alias("n")).first().n
    if size == 0:
        return tied.withColumn("bucket", F.lit(0))
    placed = tied.withColumn("__cuts", made.scalar())
    return placed.withColumn("bucket", bucket_of(_split_key(order_by), F.col("__cuts"), size)).drop("__cuts")


def fill_forward(
    df: DataFrame, columns: list[str], order_by: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Each gap takes the last value before it; a leading gap the first value after it."""
    return _fill(df, columns, order_by, rows_per_bucket, forward=True)


def fill_backward(
    df: DataFrame, columns: list[str], order_by: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Each gap takes the first value after it; a trailing gap the last value before it."""
    return _fill(df, columns, order_by, rows_per_bucket, forward=False)


def _fill(df, columns, order_by, rows_per_bucket, forward):
    """A running ``last`` inside each bucket, then what earlier buckets hand over.

    For backward filling the order is reversed. Frames only ever grow, as
    frames that shrink towards the end are evaluated from scratch per row.
    """
    bucketed = with_bucket(df, order_by, rows_per_bucket)
    handed = _handed_over(bucketed, columns, order_by, forward)
    keys = [ref(c).asc() if forward else ref(c).desc() for c in [*order_by, TIE]]
    upto = (
        Window.partitionBy("bucket")
        .orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Bounded side: one row per bucket.
    joined = bucketed.join(F.broadcast(handed), "bucket", "left")
    filled = {
        c: F.coalesce(F.last(clean_value(df, c), True).over(upto), F.col(f"__h{i}"))
        for i, c in enumerate(columns)
    }
    return joined.select(*[filled[c].alias(c) if c in filled else ref(c) for c in df.columns])


def _handed_over(bucketed, columns, order_by, forward) -> DataFrame:
    """Per bucket the value its leading gap takes."""
    key = _split_key(order_by)
    aggs = []
    for i, c in enumerate(columns):
        v = clean_value(bucketed, c)
        at = F.when(v.isNotNull(), key)
        aggs += [F.min_by(v, at).alias(f"first{i}"), F.max_by(v, at).alias(f"last{i}")]
    ends = bucketed.groupBy("bucket").agg(*aggs).orderBy("bucket").collect()
    near, far = ("first", "last") if forward else ("last", "first")
    ends = ends if forward else ends[::-1]
    handed: list[list] = [[r["bucket"]] for r in ends]
    for i in range(len(columns)):
        known = [r[f"{near}{i}"] for r in ends if r[f"{near}{i}"] is not None]
        # The gap before the very first value takes that value.
        carried = known[0] if known else None
        for r, row in zip(ends, handed):
            row.append(carried)
            if r[f"{far}{i}"] is not None:
                carried = r[f"{far}{i}"]
    kinds = [
        f"__h{i} {bucketed.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)
    ]
    return small_frame(
        bucketed.sparkSession, [tuple(r) for r in handed], ", ".join(["bucket int", *kinds])
    )


def numbered(df: DataFrame, order_by: list[str], rows_per_bucket: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``__position``: 0, 1, … in key order, counted range by range.

    The sorted ranges are written once, so every later pass reads positions instead of sorting again.
    """
    keys = [ref(c) for c in [*order_by, TIE]]
    ranges = max(1, -(-df.count() // rows_per_bucket))
    placed = with_tie(df).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop(TIE)
    # The number of the range above, the row's own in it below.
    placed = cut_lineage(placed.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__id", 33))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()
    starts, before = [], 0
    for r in sizes:
        starts.append((r["__range"], before - (r["__range"] << 33)))
        before += r["n"]
    offsets = small_frame(df.sparkSession, starts, "__range bigint, __shift bigint")
    # Bounded side: one row per range.
    joined = placed.join(F.broadcast(offsets), "__range")
    return joined.withColumn("__position", F.col("__id") + F.col("__shift")).drop("__range", "__id", "__shift")


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows in key order."""
    return first_rows(df, n, [ref(c) for c in order_by])


def sample_k(df: DataFrame, k: int, key: list[str]) -> DataFrame:
    """Exactly ``k`` rows (or all, if fewer) chosen by a seeded hash of the key."""
    keys = [ref(c) for c in key]
    return first_rows(df, k, [F.xxhash64(*keys, F.lit(V.SAMPLE_SEED)), *keys])


def first_rows(df: DataFrame, n: int, keys: list[Column], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """The ``n`` smallest rows by ``keys``.

    A plain top-k brings ``n`` rows of every input split together. Large
    tables are first narrowed to the rows up to a sampled key, as long as
    enough rows lie below it: few splits then have anything to offer.
    """
    lead, near = keys[0], df
    rows = df.count()
    while rows > max(direct_rows, n):
        known = near.select(lead.alias("key")).where(F.col("key").isNotNull())
        # About NARROWING_SAMPLE keys reach the driver.
        sample = sorted(
            r["key"]
            for r in known.sample(min(1.0, NARROWING_SAMPLE / rows), seed=V.SAMPLE_SEED).collect()
        )
        if len(sample) < 100:
            break
        narrower = df.where(lead.isNull() | (lead <= F.lit(sample[len(sample) // 100])))
        left = narrower.count()
        if left < n or left > rows // 2:
            break
        near, rows = narrower, left
    return near.orderBy(*keys).limit(n)
