"""How document filters overlap, for every order in which they may be applied.

Each document becomes a 32-bit word: bit S says whether it survives the set S of filters (five
filters have 32 sets). Positional popcounts of these words, by carry-save adders, give the
survivors of every set per part of the corpus and per label. All that is asked of an order (kept,
removed, redundant, lost) is a difference of two survivor counts, so no order reads a document.

Null text is the empty text and a null part the part ``''``. The copies filter goes by the ids: a
row fails it if a row of a smaller id, anywhere in the table, has the same text. A null id is no
smaller than any and has no smaller one; rows that repeat an id are rows of their own, not copies
of each other by that alone. A document is labelled as soon as one of its label rows says so;
labels without a document count nowhere. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.lookup import lookup
from tablewright.llm.words import slices
from tablewright.session import cut_lineage

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COPY = 1 << FILTERS.index("E")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
# For each set of failed filters, the word of the sets of filters that it survives.
SURVIVAL = np.array([sum(1 << s for s in range(ALL + 1) if not s & failed) for failed in range(ALL + 1)], np.uint32)
# Parts whose counts a task holds before it passes them on.
_HELD = 4096


@dataclass(frozen=True)
class FilterRules:
    """A: too few words; B: too few distinct ones; C: too many capitals; D: a symbol; E: a copy."""

    least_words: int = 50
    distinct_percent: int = 65
    capitals_percent: int = 5
    symbols: str = "#$%&*|"


def text_failures(text: bytes, rules: FilterRules, step: int = 1 << 20) -> int:
    """Bits of the filters A to D that a text fails. Long texts are cut at white space."""
    words, seen, at = 0, set(), 0
    while at < len(text):
        end = at + step
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        found = text[at:end].split()  # bytes split at 0x20 and 0x09 to 0x0D and nowhere else
        words += len(found)
        seen.update(found)
        at = end
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    symbols = rules.symbols.encode()
    failed = (
        words < rules.least_words,
        100 * len(seen) < rules.distinct_percent * words,
        100 * capitals > rules.capitals_percent * points,
        len(text.translate(None, symbols)) < len(text),
    )
    return sum(1 << k for k, bad in enumerate(failed) if bad)


def positional_popcounts(words: np.ndarray, bits: int = 32) -> np.ndarray:
    """For each bit position, how many of the words have that bit.

    Three words of a weight are added at a time: their sum bits stay at the weight, their carries
    go to the next one. Each weight is left with two words at most, which are counted bit by bit.
    """
    counts = np.zeros(bits, np.int64)
    level, weight = words, 1
    while len(level):
        carried = []
        while len(level) > 2:
            whole = len(level) // 3 * 3
            a, b, c = level[:whole].reshape(3, -1)
            both = a ^ b
            carried.append((a & b) | (both & c))
            level = np.concatenate([both ^ c, level[whole:]])
        for word in level.tolist():
            counts += weight * ((word >> np.arange(bits)) & 1)
        level, weight = np.concatenate(carried) if carried else level[:0], weight * 2
    return counts


def scan(docs: DataFrame, rules: FilterRules, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Per row: ``row`` (a number of its own), ``id``, ``part``, a 128-bit name of the text, ``failed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column=2):
                failed, names = [], []
                for text in piece.column(2):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    failed.append(text_failures(raw, rules))
                    names.append(hashlib.sha256(raw).digest()[:16])
                pair = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                columns = [piece.column(0), piece.column(1), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(failed, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "name_a", "name_b", "failed"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    scanned = chosen.mapInArrow(run, "id long, part string, name_a long, name_b long, failed int")
    return cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))


def with_copies(scanned: DataFrame) -> DataFrame:
    """The scanned rows, with the copies filter's bit in ``failed``."""
    repeated = scanned.groupBy("name_a", "name_b").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = lookup(scanned, repeated.drop("n"), ["name_a", "name_b"], "row")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return found.withColumn("failed", F.col("failed") + F.when(copy, F.lit(COPY)).otherwise(F.lit(0))).drop("first", "name_a", "name_b")


def survivors(docs: DataFrame, labels: DataFrame, rules: FilterRules = FilterRules(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part: ``part`` and the arrays ``rest``, ``good`` and ``toxic``.

    Element S of an array is the number of documents, documents with quality 1 and toxic documents
    that survive the set S of filters; filter k of ``FILTERS`` has the bit 1 << k.
    """
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).where("good or toxic")
    judged = cut_lineage(with_copies(scan(docs, rules, id_col, text_col, part_col)))
    judged = lookup(judged, marks, ["id"], "row")
    mark = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            code = np.asarray(parts.indices)
            words = SURVIVAL[np.asarray(batch.column(1))]
            good, toxic = (np.asarray(batch.column(k).cast(pa.uint8())).astype(bool) for k in (2, 3))
            order = np.argsort(code, kind="stable")
            for name, own in zip(parts.dictionary.to_pylist(), np.split(order, np.flatnonzero(np.diff(code[order])) + 1), strict=True):
                counts = [positional_popcounts(words[chosen]) for chosen in (own, own[good[own]], own[toxic[own]])]
                held[name] = held.get(name, 0) + np.stack(counts)
            if len(held) > _HELD:
                yield _counted(held)
                held = {}
        yield _counted(held)

    counted = judged.select("part", "failed", mark("good"), mark("toxic")).mapInArrow(run, "part string, rest array<long>, good array<long>, toxic array<long>")
    summed = [F.array(*[F.sum(F.get(F.col(c), F.lit(s))) for s in range(ALL + 1)]).alias(c) for c in ("rest", "good", "toxic")]
    return counted.groupBy("part").agg(*summed)


def _counted(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    lists = [pa.array([c[k].tolist() for c in held.values()], pa.list_(pa.int64())) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *lists], ["part", "rest", "good", "toxic"])


def _shapley(bit: int) -> Column:
    """What a filter removes, summed over all orders: each set before it stands for several."""
    own, others = 1 << bit, len(FILTERS) - 1
    weight = lambda s: factorial(s.bit_count()) * factorial(others - s.bit_count())
    return sum((_at("rest", F.lit(s)) - _at("rest", F.lit(s | own))) * weight(s) for s in range(ALL + 1) if not s & own)


def _at(counts: str, subset: Column) -> Column:
    return F.get(F.col(counts), subset)


def audit(docs: DataFrame, labels: DataFrame, rules: FilterRules = FilterRules(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does there.

    ``kept`` after the step, ``removed`` in it, ``redundant`` (failing its filter, removed
    earlier), ``unique_fails`` (failing its filter alone), ``good_lost`` and ``toxic_lost``
    (removed here and labelled so), ``shapley`` (removed by its filter, summed over all orders).
    """
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    rows = survivors(docs, labels, rules, id_col, text_col, part_col)
    rows = rows.withColumn("shares", F.array(*[_shapley(k) for k in range(len(FILTERS))]))
    rows = rows.withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda letter: F.instr("filter_order", letter)
    before = sum(F.when(place(x) < F.col("step"), F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(FILTERS))
    number = sum(F.when(place(x) == F.col("step"), F.lit(k)).otherwise(F.lit(0)) for k, x in enumerate(FILTERS))
    rows = rows.withColumn("before", before).withColumn("number", number)
    rows = rows.withColumn("own", F.expr("shiftleft(1, number)"))
    after = F.col("before") + F.col("own")
    lost = lambda c: _at(c, F.col("before")) - _at(c, after)
    failing = _at("rest", F.lit(0)) - _at("rest", F.col("own"))
    return rows.select(
        "part", "filter_order", "step",
        _at("rest", after).alias("kept"),
        lost("rest").alias("removed"),
        (failing - lost("rest")).alias("redundant"),
        (_at("rest", F.lit(ALL) - F.col("own")) - _at("rest", F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", F.col("number")).alias("shapley"),
    )


def oracle() -> str:
    """The same rows in SQL, from one row per document and the 120 orders."""
    return r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
split AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
judged AS (
  SELECT part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN s.doc_id > first THEN 16 ELSE 0 END AS failed,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM split s LEFT JOIN marks m ON s.doc_id = m.doc_id),
kinds AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, failed),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, step, bit,
    (SELECT coalesce(sum(bit), 0) FROM letters l WHERE strpos(filter_order, l.letter) < step) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step), letters
  WHERE substr(filter_order, step, 1) = letter),
found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (before::BIGINT | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before::BIGINT = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before::BIGINT > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before::BIGINT = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before::BIGINT = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM kinds, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found"""
