"""Near-duplicate texts by SetSketch registers.

A register keeps the smallest of the exponentially distributed values that a set's elements have
for it, as the number of its interval on a scale of powers of ``base``. Registers of a union are
the maxima of the registers, so sketches merge. Two sets agree in a register with a probability
close to their similarity, and from how many registers are larger, smaller and equal their joint
size follows by maximum likelihood, as both sizes are known.

The search:

1. one scan makes each text's sketch; equal shingle sets become one class before anything else;
2. bands of registers are hashed; in each bucket all classes are compared with its smallest one
   (a star, not all pairs). Likely pairs are verified on full shingle sets, and links give
   components;
3. buckets that still hold different components are compared in full, in blocks inside a task.
   Sketches tell which members may have a link into another component; only those get their full
   sets, and the same blocks verify them. Only links leave a block, one for each join of two
   components, never pairs. After that no bucket holds an unseen link.

A pair at the threshold shares no bucket with a probability of 5e-6, and less above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import graph
from tablewright.llm.words import U64, mix, slices, text_shingles
from tablewright.session import cut_lineage

_STEP = U64(0x9E3779B97F4A7C15)
ROW = "__row"


@dataclass(frozen=True)
class SketchPlan:
    """Registers, bands and thresholds.

    ``bands`` times ``rows`` registers serve as band keys, all ``registers`` serve the estimate.
    ``doubt`` is the log-likelihood that a pair may lose against the best fit before it is
    dropped (12.5: five standard deviations). ``block`` bounds the classes that are compared at a
    time, and ``task_pairs`` is how many pairs of classes a task is given to compare.
    """

    shingle: int = 5
    percent: int = 75
    registers: int = 256
    bands: int = 32
    rows: int = 4
    base: float = 1.005
    doubt: float = 12.5
    block: int = 1024
    task_pairs: int = 1 << 21


def sketch(hashes: list[np.ndarray], registers: int, base: float) -> np.ndarray:
    """Registers (uint16) of each set of element hashes; an empty set has zeros.

    Every element sends a Poisson stream of points to random registers. Points above a bound that
    holds all minima with near certainty are never made; sets with a register left open by the
    bound are done again with a larger one.
    """
    out = np.zeros((len(hashes), registers), np.uint16)
    todo = np.array([i for i, h in enumerate(hashes) if len(h)], np.int64)
    reach = math.log(registers) + 8.0
    while len(todo):
        sizes = np.array([len(hashes[i]) for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        element = np.concatenate([hashes[i] for i in todo])
        bound = reach / sizes
        least = np.full(len(todo) * registers, np.inf)
        value = np.zeros(len(element))
        step = 0
        while len(element):
            step = (step + int(_STEP)) % (1 << 64)
            point = mix(element + U64(step))
            value = value - np.log(((point >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
            near = np.flatnonzero(value <= bound[owner])
            owner, element, value, point = owner[near], element[near], value[near], point[near]
            register = (mix(point ^ U64(0xA5A5A5A5A5A5A5A5)) % U64(registers)).astype(np.int64)
            np.minimum.at(least, owner * registers + register, value)
        least = least.reshape(len(todo), registers)
        done = np.isfinite(least).all(axis=1)
        # Interval numbers, shifted so that sets of 1 to 1e12 elements stay within 16 bits.
        interval = 8192 - np.floor(np.log(least[done]) / math.log(base))
        out[todo[done]] = np.clip(interval, 1, 65535).astype(np.uint16)
        todo, reach = todo[~done], reach * 2
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihoods(larger, smaller, size_a, size_b, registers: int, base: float, similarity):
    """Log-likelihood of similarities, given how many registers of a are larger and smaller.

    Arguments are arrays that broadcast together; the smaller the set, the smaller its registers.
    """
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    ratio = (base - 1) / base
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * ratio) / math.log(base)
    up = np.clip(p(u - v * similarity), 1e-12, 1)
    down = np.clip(p(v - u * similarity), 1e-12, 1)
    same = np.clip(1 - up - down, 1e-12, 1)
    return larger * np.log(up) + smaller * np.log(down) + (registers - larger - smaller) * np.log(same)


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, plan: SketchPlan) -> np.ndarray:
    """Which pairs of rows of registers may reach the similarity. ``a`` may be one row for all."""
    wanted = plan.percent / 100
    out = np.minimum(size_a, size_b) >= wanted * np.maximum(size_a, size_b)
    # Registers agree with a probability of at least the similarity: six deviations off is far.
    far = plan.registers * wanted - 6 * math.sqrt(plan.registers * wanted * (1 - wanted))
    at = np.flatnonzero(out)
    at = at[np.count_nonzero((a if len(a) == 1 else a[at]) == b[at], axis=1) >= far]
    out[:] = False
    if len(at):
        a = a if len(a) == 1 else a[at]
        larger, smaller = np.count_nonzero(a > b[at], axis=1), np.count_nonzero(a < b[at], axis=1)
        out[at] = _may_reach(larger, smaller, size_a[at].astype(float), size_b[at].astype(float), plan)
    return out


def _may_reach(larger, smaller, size_a, size_b, plan: SketchPlan) -> np.ndarray:
    """Whether no similarity below the threshold is better supported by more than the doubt."""
    wanted = plan.percent / 100
    at = lambda s: log_likelihoods(larger, smaller, size_a, size_b, plan.registers, plan.base, s)
    best = at(wanted)
    below = np.full(best.shape, -np.inf)
    for s in np.linspace(0, wanted, 16)[:-1]:
        below = np.maximum(below, at(s))
    return below - best <= plan.doubt


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own in ``ROW``, written once so that it stays the same.

    Null and repeated ids cannot tell rows apart; this does.
    """
    return cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _scanned(docs: DataFrame, plan: SketchPlan, text_col: str) -> DataFrame:
    """Per row: number, set size, 128-bit name of the set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = text_shingles(part.column(1), plan.shingle)
                registers = sketch(sets, plan.registers, plan.base)
                names = np.array([_name(s) for s in sets], U64).view(np.int64).reshape(len(sets), 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names[:, 0]),
                        pa.array(names[:, 1]),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                    ],
                    ["id", "n", "name_a", "name_b", "registers"],
                )

    return _texts(docs, text_col).mapInArrow(run, "id long, n long, name_a long, name_b long, registers binary")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(ROW).alias("id"), F.col(text_col).cast("string").alias("text"))


def _name(hashes: np.ndarray) -> tuple[int, int]:
    if not len(hashes):
        return 0, 0
    a, b = mix(hashes ^ U64(0x1234567)), mix(hashes + _STEP)
    return int(a.sum(dtype=U64)), int(b.sum(dtype=U64))


def _band_rows(classes: DataFrame, plan: SketchPlan) -> DataFrame:
    """A row for each class and band: hash of the band's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_registers(batch.column(1), plan), plan)
            ids = np.repeat(np.asarray(batch.column(0)), plan.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "rep"])

    return classes.select("rep", "registers").mapInArrow(run, "key long, rep long")


def _registers(column, plan: SketchPlan) -> np.ndarray:
    raw = b"".join(column.to_pylist() if hasattr(column, "to_pylist") else column)
    return np.frombuffer(raw, np.uint16).reshape(-1, plan.registers)


def band_keys(registers: np.ndarray, plan: SketchPlan) -> np.ndarray:
    """Keys by row and band; the band's number is part of the key."""
    used = registers[:, : plan.bands * plan.rows].reshape(len(registers), plan.bands, plan.rows).astype(U64)
    key = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=U64) * _STEP, used.shape[:2]).copy()
    for r in range(plan.rows):
        key = mix(key ^ (used[:, :, r] + U64(r << 20)))
    return key


def _estimated(pairs: DataFrame, classes: DataFrame, plan: SketchPlan) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ra, rb = batch.columns
            keep = likely(_registers(ra, plan), _registers(rb, plan), np.asarray(na), np.asarray(nb), plan)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return joined.mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, plan: SketchPlan, text_col: str) -> DataFrame:
    """Full shingle sets of the rows in ``ids``, made anew from the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [s.tobytes() for s in text_shingles(part.column(1), plan.shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["id", "elements"])

    needed = cut_lineage(ids.distinct())
    texts = _texts(docs, text_col).join(needed, "id", "left_semi")
    return cut_lineage(texts.mapInArrow(sets, "id long, elements binary"))


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = np.concatenate([p, q])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return len(p) > 0 and 100 * common >= percent * (len(both) - common)


def _verified(pairs: DataFrame, sets: DataFrame, plan: SketchPlan) -> DataFrame:
    """The pairs (a, b) that reach the similarity on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(
                [_similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), plan.percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    side = lambda c: sets.select(F.col("id").alias(c), F.col("elements").alias(f"e_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "e_a", "e_b")
    return cut_lineage(joined.mapInArrow(run, "a long, b long"))


def _in_blocks(rows: DataFrame, plan: SketchPlan) -> tuple[DataFrame, int]:
    """Rows of buckets dealt to pairs of blocks (key, i, j), and the tasks that their pairs are worth.

    Large buckets are cut by a hash. Work grows with the square of a bucket's members, which a
    number of tasks that follows the bytes would not see.
    """
    size = cut_lineage(rows.groupBy("key").agg(F.count("rep").alias("members")))
    pairs = size.agg(F.sum(F.col("members").cast("double") * F.col("members")) / 2).first()[0] or 0
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    dealt = rows.join(size, "key").withColumn("blocks", F.ceil(F.col("members") / plan.block)).withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks", "members")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt, max(least, math.ceil(pairs / plan.task_pairs))


def _whole_groups(batches: Iterator[pa.RecordBatch], limit: int = 1 << 24) -> Iterator[pa.Table]:
    """Rows that come ordered by their first three columns, in tables that hold whole groups of these.

    A table has about ``limit`` bytes, or one group.
    """
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(_group_starts(table)[-1])
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_starts(table: pa.Table) -> np.ndarray:
    place = np.stack([np.asarray(table.column(k), np.int64) for k in range(3)])
    return np.concatenate([[0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1]) if place.shape[1] else np.zeros(1, np.int64)


def _likely_pairs(table: pa.Table, plan: SketchPlan, at_once: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of different components in one group that may be linked, for whole groups.

    A pair is dealt with in the first band that it shares, and in its own pair of blocks. Pairs of
    small and large groups are tested alike, about ``at_once`` at a time.
    """
    registers = _registers(table.column("registers"), plan)
    of = lambda c: np.asarray(table.column(c))
    comps, n, own = of("component"), of("n"), of("own")
    keys, crossing = band_keys(registers, plan), of("i") != of("j")
    band = (keys == of("key").view(U64)[:, None]).argmax(axis=1)
    starts = np.concatenate([_group_starts(table), [len(comps)]])
    end = np.repeat(starts[1:], np.diff(starts))
    later = end - np.arange(len(comps)) - 1
    upto = np.cumsum(later)
    at = 0
    while at < len(comps):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, side="right")))
        x = np.repeat(np.arange(at, to), later[at:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
        at = to
        keep = comps[x] != comps[y]
        keep &= ~crossing[x] | (own[x] != own[y])
        keep &= np.minimum(n[x], n[y]) >= plan.percent / 100 * np.maximum(n[x], n[y])
        x, y = x[keep], y[keep]
        for k in range(0, len(x), 1 << 13):
            some, others = x[k : k + (1 << 13)], y[k : k + (1 << 13)]
            earlier = (keys[some] == keys[others]) & (np.arange(plan.bands) < band[some][:, None])
            first = ~earlier.any(axis=1)
            some, others = some[first], others[first]
            near = likely(registers[some], registers[others], n[some], n[others], plan)
            if near.any():
                yield some[near], others[near]


def _between_components(rows: DataFrame, docs: DataFrame, plan: SketchPlan, text_col: str) -> DataFrame:
    """Links (a, b) between components that share buckets; rows: key, rep, component, n, registers."""
    dealt, tasks = _in_blocks(rows, plan)
    place = ["key", "i", "j"]
    facts = [*place, "own", "rep", "component", "n", "registers"]
    dealt = cut_lineage(dealt.select(*facts))
    in_place = lambda df: df.repartition(tasks, *place).sortWithinPartitions(*place)

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            marked = np.zeros(len(table), bool)
            for x, y in _likely_pairs(table, plan):
                marked[x] = marked[y] = True
            found = table.select([*place, "rep"]).filter(pa.array(marked))
            yield from found.to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            yield _first_links(table, plan)

    marked = cut_lineage(in_place(dealt).mapInArrow(involved, "key long, i int, j int, rep long"))
    sets = _sets(marked.select(F.col("rep").alias("id")), docs, plan, text_col)
    again = dealt.join(marked, [*place, "rep"]).join(sets.withColumnRenamed("id", "rep"), "rep").select(*facts, "elements")
    return cut_lineage(in_place(again).mapInArrow(verify, "a long, b long"))


def _first_links(table: pa.Table, plan: SketchPlan) -> pa.RecordBatch:
    """Verified links (a, b) of whole groups, without those between components already joined here."""
    reps, comps = (np.asarray(table.column(c)) for c in ("rep", "component"))
    sets = [np.frombuffer(e.as_buffer(), U64) for e in table.column("elements")]
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    found = []
    for some, others in _likely_pairs(table, plan):
        for x, y in zip(some.tolist(), others.tolist(), strict=True):
            a, b = root(int(comps[x])), root(int(comps[y]))
            if a != b and _similar(sets[x], sets[y], plan.percent):
                joined[max(a, b)] = min(a, b)
                found.append((reps[x], reps[y]))
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, plan: SketchPlan = SketchPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``n_shingles``, ``component_id``, ``kept``.

    Texts with a similarity of at least ``percent`` are linked; the component is the smallest id
    that links reach. ``kept`` is true for one row of each component, a row with that id. A text
    without words, or null, has the empty set: it is linked with nothing, not even with its
    equals. Rows whose id is null or repeated are rows like all others, with their own texts; a
    component of null ids alone has a null id. An empty table gives no rows.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return row_components(rows, plan, "id", "text").select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def row_components(rows: DataFrame, plan: SketchPlan = SketchPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` of ``numbered`` rows, with the row number: ``ROW``, ``id`` and the rest."""
    scanned = cut_lineage(_scanned(rows, plan, text_col))
    full = scanned.where("n > 0")
    classes = cut_lineage(
        full.groupBy("name_a", "name_b", "n").agg(F.min("id").alias("rep"), F.first("registers").alias("registers"))
    )
    bands = cut_lineage(_band_rows(classes, plan))
    hubs = cut_lineage(bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("rep").alias("members")).where("members > 1"))
    shared = cut_lineage(bands.join(hubs, "key").select("key", "rep", "hub"))
    star = shared.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    tested = cut_lineage(_estimated(star, classes, plan))
    sets = _sets(tested.select(F.explode(F.array("a", "b")).alias("id")), rows, plan, text_col)
    links = _verified(tested, sets, plan)
    found = graph.components(links)

    named = lambda comps: F.coalesce(comps["component"], F.col("rep")).alias("component")
    current = cut_lineage(shared.join(found, shared["rep"] == found["node"], "left").select("key", "rep", named(found)))
    mixed = cut_lineage(current.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"))
    open_rows = current.join(mixed, "key").join(classes.select("rep", "n", "registers"), "rep")
    open_rows = open_rows.select("key", "rep", "component", "n", "registers")
    links = links.unionByName(_between_components(open_rows, rows, plan, text_col))
    found = graph.components(links)

    members = full.select("id", "name_a", "name_b", "n").join(classes.select("name_a", "name_b", "n", "rep"), ["name_a", "name_b", "n"])
    placed = members.join(found, members["rep"] == found["node"], "left")
    placed = placed.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    empty = scanned.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    own = rows.select(F.col(ROW).alias("row"), F.col(id_col).cast("long").alias("own_id"))
    out = cut_lineage(placed.unionByName(empty).join(own, F.col("id") == F.col("row")).select("row", "own_id", "n_shingles", "component"))
    return graph.named(out).select(F.col("row").alias(ROW), F.col("own_id").alias("id"), "n_shingles", "component_id", "kept")
