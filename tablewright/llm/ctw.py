"""Context-tree weighting over bytes, and a word-count baseline beside it.

Texts are lower-cased (A-Z) and read as words joined by single spaces with one end byte, so the
model gives a probability to the same token sequence as the baseline. A byte is eight binary
decisions. Each decision has a tree of contexts, the last 0 to ``depth`` bytes, with
Krichevsky-Trofimov counts at every node; a node's weighted probability is the mean of its own
estimate's and its children's product. From the training counts follows, at every node, the weight
of stopping there, and a decision's probability mixes the estimates of all depths along its
context. A context that never occurred adds nothing: its parent's mixture stands.

Nothing that grows with the corpus is broadcast. One scan counts words and byte sequences
("grams": context and byte), summed in each task before the shuffle. Nodes of three and more bytes
live where their grams were dealt to by their last three bytes; only nodes of up to two bytes, at
most 256 * 256 * 255, are gathered. Each gram's log-probability is found there. A second scan
scores the texts: the most frequent words and grams (bounded tables) at once, all others by
a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.words import U64, buffers, slices, word_hashes, word_spans
from tablewright.session import cut_lineage

WORD, GRAM = 0, 1
END_WORD = U64(0)
END = 10


@dataclass(frozen=True)
class TreePlan:
    """Context bytes (3 to 6), and sizes of the tables of frequent words and grams."""

    depth: int = 5
    frequent_words: int = 1 << 18
    frequent_grams: int = 1 << 20

    def __post_init__(self):
        if not 3 <= self.depth <= 6:
            raise ValueError("depth must be 3 to 6")


def sequences(data: np.ndarray, borders: np.ndarray, depth: int):
    """Word hashes, words before each text, gram keys, and grams before each text."""
    starts, ends, counts = word_spans(data, borders)
    lengths, n_words = ends - starts, np.diff(counts)
    n = len(n_words)
    owner = np.repeat(np.arange(n), n_words)
    size = depth + np.bincount(owner, lengths + 1, n).astype(np.int64) + (n_words == 0)
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.cumsum(lengths + 1) - (lengths + 1)
    empty = np.cumsum(n_words == 0) - (n_words == 0)
    gaps = at + depth * (owner + 1) + empty[owner] + lengths
    out = np.full(begin[-1], 32, np.uint8)
    filled = np.ones(begin[-1], bool)
    filled[gaps] = False
    pads = begin[:-1, None] + np.arange(depth)
    filled[pads] = False
    filled[begin[1:] - 1] = False
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    out[filled] = data[np.cumsum(inside[: len(data)], dtype=np.int8).astype(bool)]
    out[pads] = END
    out[begin[1:] - 1] = END
    scored = np.ones(len(out), bool)
    scored[pads] = False
    wide = out.astype(U64)
    keys = np.zeros(len(out), U64)
    for d in range(1, depth + 1):
        keys[depth:] |= wide[depth - d : len(out) - d] << U64(8 * (depth - d + 1))
    keys |= wide
    return word_hashes(data, starts, ends), counts, keys[scored], begin - depth * np.arange(n + 1)


def _summed(keys: list[np.ndarray], train: list[np.ndarray], every: list[np.ndarray]):
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    add = lambda parts: np.bincount(at, np.concatenate(parts), len(key)).astype(np.int64)
    return key, add(train), add(every)


def _counts(docs: DataFrame, plan: TreePlan) -> DataFrame:
    """How often each word and gram occurs in training texts and in all; docs: id, text, learns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        for batch in batches:
            for part in slices(batch):
                data, borders = buffers(part.column(1))
                words, counts, grams, begins = sequences(data, borders, plan.depth)
                learns = np.asarray(part.column(2)).astype(bool)
                words = np.concatenate([words, np.full(len(learns), END_WORD)])
                in_train = np.concatenate([np.repeat(learns, np.diff(counts)), learns])
                for kind, keys, train in ((WORD, words, in_train), (GRAM, grams, np.repeat(learns, np.diff(begins)))):
                    every, n = np.unique(keys, return_counts=True)
                    own, m = (every, n) if train.all() else np.unique(keys[train], return_counts=True)
                    learnt = np.zeros(len(every), np.int64)
                    learnt[np.searchsorted(every, own)] = m
                    held[kind].append((every, learnt, n))
                    if sum(len(h[0]) for h in held[kind]) > 4_000_000:
                        held[kind] = [_summed(*zip(*held[kind], strict=True))]
        for kind, parts in held.items():
            if parts:
                key, train, every = _summed(*zip(*parts, strict=True))
                for k in range(0, len(key), 100_000):
                    cut = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key[cut]), kind, np.int32)), pa.array(key[cut].view(np.int64)), pa.array(train[cut]), pa.array(every[cut])],
                        ["kind", "key", "train", "every"],
                    )

    found = docs.mapInArrow(run, "kind int, key long, train long, every long")
    return cut_lineage(found.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("every").alias("every")))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after six steps up."""
    y = x + 6
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def node_keys(grams: np.ndarray, depth: int, context: int, bit: int) -> np.ndarray:
    """Nodes of a gram's decision: the last ``context`` bytes, and the bits of the byte so far."""
    byte = grams & U64(255)
    so_far = (U64(1) << U64(bit)) | (byte >> U64(8 - bit))
    return (grams >> U64(8 * (depth - context) + 8) << U64(8)) | so_far


def _bit(grams: np.ndarray, bit: int) -> np.ndarray:
    return ((grams >> U64(7 - bit)) & U64(1)).astype(bool)


def _level(grams: np.ndarray, counts: np.ndarray, depth: int, context: int):
    """Nodes of one context length with their counts."""
    keys = np.concatenate([node_keys(grams, depth, context, b) for b in range(8)])
    ones = np.concatenate([np.where(_bit(grams, b), counts, 0) for b in range(8)])
    node, at = np.unique(keys, return_inverse=True)
    total, one = np.bincount(at, np.tile(counts, 8), len(node)), np.bincount(at, ones, len(node))
    return node, total - one, one


def _parents(nodes: np.ndarray) -> np.ndarray:
    return (nodes >> U64(16) << U64(8)) | (nodes & U64(255))


def _stop(node, zeros, ones, below):
    """Log weighted probability, and the weight of stopping here, given the children's log product."""
    own = log_kt(zeros, ones)
    return np.logaddexp(own, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - own, -500, 500)))


def _deep(grams: np.ndarray, counts: np.ndarray, depth: int):
    """Levels of 3 bytes and more: {context: (nodes, zeros, ones, stop)}; log products for 2 bytes."""
    levels, child = {}, None
    for context in range(depth, 2, -1):
        node, zeros, ones = _level(grams, counts, depth, context)
        if child is None:
            weighted, stop = log_kt(zeros, ones), np.ones(len(node))
        else:
            below = np.bincount(np.searchsorted(node, _parents(child[0])), child[1], len(node))
            weighted, stop = _stop(node, zeros, ones, below)
        levels[context] = (node, zeros, ones, stop)
        child = (node, weighted)
    node, at = np.unique(_parents(child[0]), return_inverse=True)
    zeros, ones = levels[3][1], levels[3][2]
    return levels, (node, np.bincount(at, zeros, len(node)), np.bincount(at, ones, len(node)), np.bincount(at, child[1], len(node)))


def _shallow(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> dict:
    """Levels of 2, 1 and 0 bytes."""
    levels = {}
    for context in (2, 1, 0):
        weighted, stop = _stop(node, zeros, ones, below)
        levels[context] = (node, zeros, ones, stop)
        if context:
            parent, at = np.unique(_parents(node), return_inverse=True)
            zeros, ones, below, node = np.bincount(at, zeros), np.bincount(at, ones), np.bincount(at, weighted), parent
    return levels


def gram_log_probabilities(grams: np.ndarray, levels: dict, depth: int) -> np.ndarray:
    """Natural log-probability of each gram's byte after its context."""
    out = np.zeros(len(grams))
    for bit in range(8):
        one = _bit(grams, bit)
        mixed, seen = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for context in range(depth, -1, -1):
            node, zeros, ones, stop = levels[context]
            if not len(node):
                continue
            key = node_keys(grams, depth, context, bit)
            at = np.minimum(np.searchsorted(node, key), len(node) - 1)
            here = node[at] == key
            p = (ones[at] + 0.5) / (zeros[at] + ones[at] + 1.0)
            p = np.where(one, p, 1 - p)
            mixed = np.where(here, np.where(seen, stop[at] * p + (1 - stop[at]) * mixed, p), mixed)
            seen |= here
        out += np.log(mixed)
    return out


def _dealt(grams: DataFrame, plan: TreePlan) -> DataFrame:
    """Grams dealt by the last three bytes of their context, rows of a partition read as a whole."""
    count = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grams.repartition(count, F.shiftright("key", 8 * (plan.depth - 2)))


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]).view(U64), np.concatenate([p[1] for p in parts])


def _gram_table(counts: DataFrame, plan: TreePlan) -> DataFrame:
    """Every gram with its log-probability (natural) and how often it occurs in all texts."""
    dealt = cut_lineage(_dealt(counts.where(F.col("kind") == GRAM).select("key", "train", "every"), plan))
    again = lambda: _dealt(dealt, plan)

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, train = _whole(batches)
        grams, train = grams[train > 0], train[train > 0]
        if len(grams):
            _, (node, zeros, ones, below) = _deep(grams, train, plan.depth)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(below)], ["node", "zeros", "ones", "below"])

    # At most 256 * 256 contexts of 255 nodes each, whatever the corpus.
    top = again().select("key", "train").mapInArrow(upward, "node long, zeros double, ones double, below double")
    rows = top.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).orderBy("node").toPandas()
    shallow = _shallow(rows["node"].to_numpy(np.int64).view(U64), *(rows[c].to_numpy(float) for c in ("zeros", "ones", "below")))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        grams, train = _whole(iter(kept))
        if len(grams):
            every = np.concatenate([np.asarray(b.column(2)) for b in kept])
            learnt = train > 0
            if learnt.any():
                levels = {**shallow, **_deep(grams[learnt], train[learnt], plan.depth)[0]}
            else:
                levels = {**shallow, **{c: (np.zeros(0, U64),) * 4 for c in range(3, plan.depth + 1)}}
            value = gram_log_probabilities(grams, levels, plan.depth)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(value), pa.array(every)], ["key", "value", "every"])

    return again().mapInArrow(downward, "key long, value double, every long")


def _frequent(values: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, values and known flags of the most frequent keys, at most ``most`` of them.

    A histogram of the counts' logarithms gives the count from which on they fit; nothing is sorted.
    """
    level = F.floor(F.log2("every") * 8).cast("int")
    sizes = values.groupBy(level.alias("level")).agg(F.count("key").alias("n")).collect()
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r.level):
        held += r.n
        if held > most:
            break
        least = r.level
    if least is None:
        return np.zeros(0, U64), np.zeros(0), np.zeros(0, bool)
    rows = values.where(level >= least).select("key", "value", "known").toPandas()
    key = rows["key"].to_numpy(np.int64).view(U64)
    order = np.argsort(key)
    return key[order], rows["value"].to_numpy(float)[order], rows["known"].to_numpy(bool)[order]


def _looked_up(keys: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, known flags, and which keys the table lacks."""
    names, values, known = table
    if not len(names):
        return np.zeros(len(keys)), np.zeros(len(keys), bool), np.ones(len(keys), bool)
    every, at = np.unique(keys, return_inverse=True)
    place = np.minimum(np.searchsorted(names, every), len(names) - 1)
    there = names[place] == every
    return np.where(there, values[place], 0.0)[at], (known[place] & there)[at], ~there[at]


def score(docs: DataFrame, learns: Column, plan: TreePlan = TreePlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``,
    ``n_bytes`` and ``bits_per_byte`` (of the normalised text with its end).

    Learns from rows where ``learns`` (a column of the table; null: no) holds. Null and empty texts
    are the end alone. Without training rows the baseline is 0 for every text and the model gives
    every bit one half. Repeated rows are scored alike; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    counts = _counts(own, plan)
    words = counts.where(F.col("kind") == WORD)
    sums = words.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    norm = math.log10(sums.n + 0.1 * (sums.v + 1))
    valued_words = words.select("kind", "key", (F.log10(F.col("train") + 0.1) - norm).alias("value"), (F.col("train") > 0).alias("known"), "every")
    valued_grams = _gram_table(counts, plan).select(F.lit(GRAM).alias("kind"), "key", (F.col("value") / math.log(10)).alias("value"), F.lit(True).alias("known"), "every")
    values = cut_lineage(valued_words.unionByName(valued_grams))
    frequent = lambda kind, n: _frequent(values.where(F.col("kind") == kind), n)
    # Bounded by the plan: 4 and 17 MB at most.
    tables = own.sparkSession.sparkContext.broadcast({WORD: frequent(WORD, plan.frequent_words), GRAM: frequent(GRAM, plan.frequent_grams)})
    depth = plan.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_type = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int32())]))
        for batch in batches:
            for part in slices(batch):
                data, borders = buffers(part.column(1))
                hashes, word_at, grams, gram_at = sequences(data, borders, depth)
                n = len(word_at) - 1
                # The end is a word of every text, after its own.
                ends = word_at[1:] + np.arange(n)
                words = np.full(len(hashes) + n, END_WORD)
                place = np.ones(len(words), bool)
                place[ends] = False
                words[place] = hashes
                word_at = word_at + np.arange(n + 1)
                columns, rare = {}, []
                for kind, keys, at in ((WORD, words, word_at), (GRAM, grams, gram_at)):
                    value, known, lacks = _looked_up(keys, tables.value[kind])
                    owner = np.repeat(np.arange(n), np.diff(at))
                    columns[kind] = (np.bincount(owner, value, n), np.bincount(owner, known, n).astype(np.int64))
                    missing = np.flatnonzero(lacks)
                    rare.append((owner[missing], np.full(len(missing), kind, np.int32), keys[missing].view(np.int64)))
                owner, kinds, keys = (np.concatenate(c) for c in zip(*rare, strict=True))
                order = np.lexsort((keys, kinds, owner))
                owner, kinds, keys = owner[order], kinds[order], keys[order]
                first = np.ones(len(owner), bool)
                first[1:] = (owner[1:] != owner[:-1]) | (kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1])
                at = np.flatnonzero(first)
                times = np.diff(np.append(at, len(owner))).astype(np.int32)
                offsets = pa.array(np.searchsorted(owner[at], np.arange(n + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(kinds[at]), pa.array(keys[at]), pa.array(times)], fields=list(rare_type.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(word_at)), pa.array(np.diff(gram_at)), pa.array(columns[WORD][0]), pa.array(columns[WORD][1]), pa.array(columns[GRAM][0]), lists],
                    ["id", "n_tokens", "n_bytes", "base", "known", "model", "rare"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    scanned = own.mapInArrow(run, f"id {kind}, n_tokens long, n_bytes long, base double, known long, model double, rare array<struct<kind: int, key: long, n: int>>")
    scanned = cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))
    asked = scanned.select("row", F.explode("rare").alias("r")).select("row", "r.kind", "r.key", "r.n")
    answered = asked.join(values.select("kind", "key", "value", "known"), ["kind", "key"])
    late = answered.groupBy("row").agg(
        F.sum(F.when(F.col("kind") == WORD, F.col("value") * F.col("n"))).alias("more_base"),
        F.sum(F.when((F.col("kind") == WORD) & F.col("known"), F.col("n"))).alias("more_known"),
        F.sum(F.when(F.col("kind") == GRAM, F.col("value") * F.col("n"))).alias("more_model"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scanned.join(late, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(int(sums.n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("model") + zero("more_model")).alias("score"), "n_bytes",
    )
    return out.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes"))
