"""CSV whose quoted fields hold line breaks, read by as many tasks as any other CSV.

Whether a line starts inside a quoted field depends on everything before it, but a line can only do
one of four things with that state: keep it, turn it round, or leave it open or closed whatever it
was. So

1. each byte range of a file reports what all its lines together do with the state, in one scan;
2. a running window over the ranges of a file tells the state at the start of each;
3. each range is cut into records by itself. A record that goes over ranges leaves one piece in each
   of them, and only those pieces are shuffled and joined.

The records are written to the shared folder: the ranges depend on how many cores a cluster has at
the moment, so both scans are run at once, with the number of ranges held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

#: Encodings in which a line feed, a comma and a quote are single bytes that occur in nothing else.
ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII", "WINDOWS-1252")
#: Ranges whose states are broadcast (at most 100 bytes each); beyond that lines are shuffled.
BROADCAST_RANGES = 200_000

_BODY = rb'[^"]*+(?:""[^"]*+)*+'
_FIELDS = re.compile(rb'(?:(?:"' + _BODY + rb'"[^,]*+|[^",][^,]*+|),)*+')
_OPENED = re.compile(rb'"' + _BODY + rb"\Z")
_CLOSED = re.compile(_BODY + rb'"[^,]*+')
# What became of a record in a range: it lies in it, begins, goes through, or ends there.
WHOLE, BEGINS, THROUGH, ENDS = range(4)


def ends_open(line: bytes, is_open: bool) -> bool:
    """Whether a line that starts inside a quoted field, or outside of one, ends inside of one.

    A quote opens a field only as the field's first character; what follows its closing quote up to
    the next comma belongs to the field.
    """
    at = 0
    if is_open:
        closed = _CLOSED.match(line)
        if closed is None:
            return True
        at = closed.end() + 1
    return _OPENED.match(line, _FIELDS.match(line, at).end()) is not None if at <= len(line) else False


def records(spark: SparkSession, files: list[str], encoding: str) -> DataFrame | None:
    """All records of the files but empty lines and each file's header: one text column, ``record``.

    None if a file has carriage returns alone as line ends; such files have to be read whole.
    """
    with held_ranges(spark):
        lines = spark.read.option("lineSep", "\n").text(files)
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("size")]
        lines = lines.select(*place, F.col("value").cast("binary").alias("line"))
        ranges = cut_lineage(lines.mapInArrow(_summed, "file string, start long, size long, opened boolean, open_stays boolean, lone boolean"))
        if ranges.where("lone").limit(1).count():
            return None
        found = cut_lineage(_cut(lines, _with_state(ranges)))
    whole = found.where(F.col("piece") == WHOLE).select("file", "start", "n", "text")
    found = whole.unionByName(_joined(found.where(F.col("piece") != WHOLE)))
    # Numbers alone are hashed; with their texts, records would be sorted by file. One row per file is broadcast.
    first = found.groupBy("file", "start").agg(F.min("n").alias("n")).groupBy("file").agg(F.min(F.struct("start", "n")).alias("at"))
    header = found.join(F.broadcast(first.select("file", "at.*")), ["file", "start", "n"])
    header = cut_lineage(header.select("file", F.col("start").alias("first_start"), F.col("n").alias("first_n"), _ends_in_cr(F.col("text")).alias("cr")))
    kept = found.join(F.broadcast(header), "file").where((F.col("start") != F.col("first_start")) | (F.col("n") != F.col("first_n")))
    # As the reader of whole files has it: where lines end in CR LF, quoted ends become LF too.
    record = _decoded(F.col("text"), encoding)
    return kept.select(F.when(F.col("cr"), F.replace(record, F.lit("\r\n"), F.lit("\n"))).otherwise(record).alias("record"))


@contextmanager
def held_ranges(spark: SparkSession):
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _ends_in_cr(text: Column) -> Column:
    """Whether the first line of a record ends in CR."""
    return F.endswith(F.substring_index(text.cast("string"), "\n", 1), F.lit("\r"))


def _decoded(text: Column, encoding: str) -> Column:
    ended = F.when(F.endswith(text, F.lit(b"\r")), F.expr("substring(text, 1, length(text) - 1)")).otherwise(text)
    return ended.cast("string") if encoding.upper() == "UTF-8" else F.decode(ended, encoding)


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of a batch that belong to one range; lines of a range come together and in order."""
    file, start = batch.column(0).dictionary_encode().indices.to_numpy(), np.asarray(batch.column(1))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield (batch.column(0)[a].as_py(), int(start[a]), batch.column(2)[a].as_py()), batch.slice(a, b - a)


def _quoting(lines: pa.Array) -> Iterator[tuple[int, bytes]]:
    """Places and bytes of the lines with a quote; no other changes a state."""
    for k in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist():
        yield k, lines[k].as_py()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: how it ends if it starts closed, and if it starts open."""
    found: dict[tuple, list[bool]] = {}
    for batch in batches:
        for key, part in _segments(batch):
            state = found.setdefault(key, [False, True, False])
            for _, line in _quoting(part.column(3)):
                state[0], state[1] = ends_open(line, state[0]), ends_open(line, state[1])
            state[2] |= bool(pc.any(pc.match_substring_regex(part.column(3), "\r[^\r]")).as_py())
    columns = [*zip(*found)] + [*zip(*found.values(), strict=True)] if found else [()] * 6
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "size", "opened", "open_stays", "lone"])


def _with_state(ranges: DataFrame) -> DataFrame:
    """``is_open`` at the start of each range: the last range that forgets its state says it, and
    every range since then that turns it round turns it once."""
    forgets, turns = F.col("opened") == F.col("open_stays"), F.col("opened") & ~F.col("open_stays")
    order = Window.partitionBy("file").orderBy("start")
    ranges = ranges.withColumn("turned", F.sum(turns.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(forgets, F.struct(F.col("opened").cast("int").alias("open"), "turned")), ignorenulls=True).over(before)
    turned = F.coalesce(F.last("turned").over(before), F.lit(0))
    ranges = ranges.withColumn("known", known).withColumn("turned_before", turned)
    state = F.coalesce(F.col("known.open"), F.lit(0)) + F.col("turned_before") - F.coalesce(F.col("known.turned"), F.lit(0))
    return cut_lineage(ranges.select("file", "start", "size", (state % 2 == 1).alias("is_open")))


def _cut(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces of records: ``file``, ``start``, ``n`` (order in the range), ``piece``, ``text``."""
    keys = ["file", "start", "size"]
    if states.count() <= BROADCAST_RANGES:
        placed = lines.join(F.broadcast(states), keys, "left")
    else:
        numbered = lines.withColumn("line_number", F.monotonically_increasing_id())
        placed = numbered.join(states, keys, "left").repartition(*keys).sortWithinPartitions(*keys, "line_number")
    # Ranges that the first scan has not seen would be cut wrongly.
    is_open = F.coalesce("is_open", F.raise_error(F.lit("byte ranges changed between two scans")).cast("boolean"))
    return placed.select(*keys, "line", is_open.alias("is_open")).mapInArrow(_pieces, "file string, start long, n long, piece int, text binary")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, entered, n = None, False, False, 0
    waiting: list[pa.Array] = []

    def rows(texts: pa.Array, pieces: np.ndarray) -> pa.RecordBatch:
        count = len(texts)
        columns = [pa.array([key[0]] * count, pa.string()), pa.array([key[1]] * count, pa.int64()), pa.array(np.arange(n, n + count)), pa.array(pieces, pa.int32()), texts]
        made = pa.RecordBatch.from_arrays(columns, ["file", "start", "n", "piece", "text"])
        blank = pc.is_in(texts, value_set=pa.array([b"", b"\r"], pa.binary()))
        return made.filter(pc.invert(pc.and_(blank, pa.array(pieces == WHOLE))))

    def rest() -> Iterator[pa.RecordBatch]:
        if waiting:
            kind = THROUGH if entered else BEGINS
            yield rows(_one(pa.concat_arrays(waiting)), np.array([kind]))

    for batch in batches:
        for found, part in _segments(batch):
            if found != key:
                yield from rest()
                key, n, waiting = found, 0, []
                state = entered = bool(part.column(4)[0].as_py())
            lines = part.column(3).cast(pa.binary())
            after = np.full(len(lines), -1)
            now = state
            for k, line in _quoting(lines):
                now = ends_open(line, now)
                after[k] = now
            last = np.maximum.accumulate(np.where(after >= 0, np.arange(len(after)), -1))
            closed = np.where(last >= 0, after[last], int(state)) == 0
            state = now
            ends = np.flatnonzero(closed) + 1
            if len(ends):
                held = sum(map(len, waiting))
                everything = pa.concat_arrays([*waiting, lines])
                offsets = pa.array(np.concatenate([[0], ends + held]), pa.int32())
                complete = int(ends[-1]) + held
                texts = pc.binary_join(pa.ListArray.from_arrays(offsets, everything.slice(0, complete)), b"\n")
                pieces = np.full(len(texts), WHOLE)
                pieces[0] = ENDS if entered else WHOLE
                yield rows(texts, pieces)
                n, entered, waiting = n + len(texts), False, []
                lines = everything.slice(complete)
            if len(lines):
                waiting.append(lines)
    yield from rest()


def _one(lines: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), b"\n")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that go over ranges, from at most two pieces in each range."""
    order = Window.partitionBy("file").orderBy("start", "n")
    pieces = pieces.withColumn("number", F.sum((F.col("piece") == BEGINS).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "n", F.hex("text").alias("text"))))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["text"]), "0A"))
    joined = pieces.groupBy("file", "number").agg(parts.alias("parts"))
    return joined.select("file", F.get("parts", F.lit(0))["start"].alias("start"), F.get("parts", F.lit(0))["n"].alias("n"), whole.alias("text"))
