"""Vector bin packing of token sequences.

A sequence (bin) has a limit on tokens, on segments and on loss-bearing tokens. The next example
is the one whose demand has the largest dot product with what is left, both as shares of the
limits, so scarce dimensions weigh little and roomy ones much. Examples wait in a pool of bounded
size in each task; whole sequences leave the task as soon as they are closed. Packing therefore
needs no shuffle, and a hot source or a long document is just more rows of its task.

Where pieces may be cut, an open sequence that nothing fits is filled with the head of the example
that would have been chosen, as far as its loss-bearing tokens allow. A sequence that another limit
closes early keeps the largest power of two of its tokens, which needs no padding; the rest goes back
into the pool. What a task has left at its end goes into sequences whose sizes are powers of two.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_PIECES = 400_000
# Sequence ids: the task's number above, its own count below.
TASK_SHIFT = 40


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``pool`` bounds the examples that wait in a task."""

    tokens: int = 1024
    segments: int = 512
    loss_tokens: int = 1024
    pool: int = 256

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens, self.pool) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Example:
    """Something to place: ``loss`` of its ``tokens`` count towards the loss.

    ``tag`` says what it is to the caller, ``start`` where it lies in its document. ``bearing[i]`` is
    the number of loss-bearing tokens before token ``first + i`` of the document; without it they
    are the example's first ones.
    """

    tag: object
    start: int
    tokens: int
    loss: int
    bearing: np.ndarray | None = None
    first: int = 0

    def head_loss(self, tokens: int) -> int:
        """Loss-bearing tokens among the first ``tokens``."""
        if self.bearing is None:
            return min(self.loss, tokens)
        at = self.start - self.first
        return int(self.bearing[at + tokens] - self.bearing[at])

    def head_within(self, room: int) -> int:
        """How many tokens of the head bear at most ``room`` loss."""
        if self.loss <= room:
            return self.tokens
        if self.bearing is None:
            return room
        at = self.start - self.first
        return int(np.searchsorted(self.bearing[at : at + self.tokens + 1], self.bearing[at] + room, "right")) - 1

    def divide(self, tokens: int) -> tuple[Example, Example | None]:
        if tokens >= self.tokens:
            return self, None
        loss = self.head_loss(tokens)
        return (
            Example(self.tag, self.start, tokens, loss, self.bearing, self.first),
            Example(self.tag, self.start + tokens, self.tokens - tokens, self.loss - loss, self.bearing, self.first),
        )


# Shorter heads are cut only if they fill the sequence.
LEAST_HEAD = 32


class Packer:
    """Places examples; ``cut`` says whether an example may be divided between sequences."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        # A sequence that closes early returns members to the pool: at most its segments.
        slots = limits.pool + limits.segments + 1
        # Demands of the slots as shares of the limits (0 where nothing waits), and as they are (inf).
        self.shares = np.zeros((3, slots))
        self.tokens, self.loss = np.full(slots, np.inf), np.full(slots, np.inf)
        self.free = list(range(slots - 1, -1, -1))
        self.waiting: list[Example | None] = [None] * slots
        self.count = 0

    def add(self, example: Example) -> Iterator[list[Example]]:
        """Take one example; yields the sequences that this closes."""
        lim = self.limits
        if not self.cut and (example.tokens > lim.tokens or example.loss > lim.loss_tokens):
            yield [example]  # fits nowhere: alone, and over the limit
            return
        self._wait(example)
        if self.count >= lim.pool:
            yield from self._close(lim.pool // 2)

    def finish(self) -> Iterator[list[Example]]:
        yield from self._close(0)

    def _wait(self, example: Example) -> None:
        self._put(self.free.pop(), example)
        self.count += 1

    def _put(self, slot: int, example: Example) -> None:
        self.waiting[slot], self.tokens[slot], self.loss[slot] = example, example.tokens, example.loss
        self.shares[:, slot] = (example.tokens, 1, example.loss) / self.caps

    def _close(self, leave: int) -> Iterator[list[Example]]:
        """Fill sequences until at most ``leave`` examples wait."""
        while self.count > leave:
            left, members = self.caps.copy(), []
            while self.count and left[0] > 0 and left[1] > 0:
                head = self._choose(left)
                if head is None:
                    break
                members.append(head)
                left -= (head.tokens, 1, head.loss)
            used = sum(m.tokens for m in members)
            if not self.cut or used == self.limits.tokens or not used & (used - 1):
                yield members
            elif self.count == 0:
                yield from self._powers(members)
            else:
                kept, back = self._split(members, 1 << (used.bit_length() - 1))
                for example in back:
                    self._wait(example)
                yield kept

    def _choose(self, left: np.ndarray) -> Example | None:
        scores = (left / self.caps) @ self.shares
        if self.cut and left[1] == 1:
            fits = (self.tokens == left[0]) & (self.loss <= left[2])  # the last segment has to fill the sequence
        else:
            fits = (self.tokens <= left[0]) & (self.loss <= left[2])
        slot = int((scores * fits).argmax())
        if fits[slot]:
            return self._take(slot)
        if not self.cut:
            return None
        slot = int(scores.argmax())
        waiting = self.waiting[slot]
        tokens = min(int(left[0]), waiting.head_within(int(left[2])))
        if tokens < min(int(left[0]), LEAST_HEAD, waiting.tokens):
            return None
        head, rest = waiting.divide(tokens)
        if rest is None:
            return self._take(slot)
        self._put(slot, rest)
        return head

    def _take(self, slot: int) -> Example:
        example, self.waiting[slot] = self.waiting[slot], None
        self.tokens[slot] = self.loss[slot] = np.inf
        self.shares[:, slot] = 0
        self.free.append(slot)
        self.count -= 1
        return example

    @staticmethod
    def _split(members: list[Example], tokens: int) -> tuple[list[Example], list[Example]]:
        """The first ``tokens`` tokens of a sequence, and what lies behind them."""
        kept, back = [], []
        for m in members:
            if tokens > 0:
                head, rest = m.divide(tokens)
                kept.append(head)
                tokens -= head.tokens
                back += [rest] if rest is not None else []
            else:
                back.append(m)
        return kept, back

    def _powers(self, members: list[Example]) -> Iterator[list[Example]]:
        """Divide an unfilled sequence into sequences of powers of two."""
        while members:
            total = sum(m.tokens for m in members)
            kept, members = self._split(members, 1 << (total.bit_length() - 1))
            yield kept


def pack_examples(examples: DataFrame, limits: Limits, id_col: str = "id", tokens_col: str = "n_tokens", loss_col: str = "n_loss") -> DataFrame:
    """Place whole examples (instruction data) into sequences: columns id, ``n_tokens``, ``n_loss``,
    ``sequence_id``, ``offset``, ``segment``.

    Null counts are zero; an example of no tokens takes part as a segment without tokens of its own
    only if other columns ask for it, so it is placed with offset 0 in a sequence alone. More loss
    than tokens, or negative counts, raise. An example over a limit gets a sequence of its own.
    Repeated ids are separate examples; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut=False)
        base, made, kind = TaskContext.get().partitionId() << TASK_SHIFT, 0, pa.int64()
        schema = pa.schema([("id", kind), ("n_tokens", pa.int64()), ("n_loss", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32())])

        def emit(sequences):
            nonlocal made
            rows = []
            for members in sequences:
                offset = 0
                for k, m in enumerate(members):
                    rows.append((m.tag, m.tokens, m.loss, base + made, offset, k))
                    offset += m.tokens
                made += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            kind = batch.schema.field(0).type
            schema = schema.set(0, pa.field("id", kind))
            closed = []
            for tag, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tokens < 0 or not 0 <= loss <= tokens:
                    raise ValueError(f"{tokens} tokens with {loss} loss-bearing ones")
                example = Example(tag, 0, tokens, loss)
                closed += [[example]] if tokens == 0 else packer.add(example)
            yield emit(closed)
        yield emit(packer.finish())

    kind_name = examples.schema[id_col].dataType.simpleString()
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    chosen = examples.select(F.col(id_col).alias("id"), zero(tokens_col).alias("n_tokens"), zero(loss_col).alias("n_loss"))
    packed = chosen.mapInArrow(run, f"id {kind_name}, n_tokens long, n_loss long, sequence_id long, offset long, segment int")
    return packed.withColumnRenamed("id", id_col)


# How byte-level tokenizers split a text, and the same for texts of the first 592 code points
# without the few whose classes differ between the two libraries; that one is twice as fast.
_SPLIT = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
_LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN_SPLIT = re.compile(f" ?[{_LETTERS}]++| ?[0-9]++|'(?:[stmd]|re|ve|ll)| ?[^\\s0-9{_LETTERS}]++|\\s+(?!\\S)|\\s+").findall
_NOT_PLAIN = re.compile("[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]").search


def _ranked(spec: dict):
    """The same merges as a faster encoder of pieces, if the file is plain byte-level BPE whose
    ids are in the order of its merges; else None."""
    import tiktoken

    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    )
    if not plain:
        return None
    # Byte-level files write the visible Latin-1 characters as themselves, and the other bytes,
    # in order, as the characters from 256 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in merges]
    made = {t for t in vocabulary if len(t) == 1} | {a + b for a, b in merges}
    special = {t["content"] for t in spec["added_tokens"]}
    if order != sorted(order) or set(vocabulary) - special != made - special:
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    pattern = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class DocumentTokens(dict):
    """Ids of whole texts by a tokenizer file with byte-level BPE.

    Texts are split as the tokenizer does; each distinct piece is encoded once (two generations
    are remembered), by the library itself or, where the file allows, by a faster one with the same merges. A text with a special token's string is encoded whole, and the
    string is that token, as the library has it by default.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        self.old: dict[str, bytes] = {}
        self.missed: list[str] = []
        self.ranked = _ranked(json.loads(self.tokenizer.to_str()))
        line = self.ranked.encode_ordinary("\n") if self.ranked else []
        self.line = line[0] if len(line) == 1 else None

    def __missing__(self, piece: str) -> None:
        """Pieces that are asked for in vain are noted, so that no list of ids is searched for gaps."""
        self.missed.append(piece)

    def _coded(self, texts: list[str]) -> Iterator[bytes]:
        for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", coded.ids).tobytes()

    def _coded_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces without inner white space are encoded by the line, many at a time: a line feed
        is a piece of its own before them, whatever they begin with."""
        lines, others = [], []
        for p in pieces:
            (lines if self.line is not None and p.split() == [p[1:] if p[0] == " " else p] else others).append(p)
        for k in range(0, len(lines), 4096):
            block = lines[k : k + 4096]
            ids = np.array(self.ranked.encode_ordinary("\n".join(block)), "<u4")
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) != len(block) - 1:
                raise ValueError("the tokenizer does not keep lines apart")
            whole, borders = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
            yield from ((p, whole[4 * a + 4 : 4 * b]) for p, a, b in zip(block, borders[:-1], borders[1:], strict=True))
        yield from zip(others, self._coded(others), strict=True)

    def _learn(self, pieces: set[str]) -> None:
        unknown = []
        for piece in pieces:
            if (known := self.old.get(piece)) is not None:
                self[piece] = known
            else:
                unknown.append(piece)
        self.update(self._coded_pieces(unknown))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, with one closing id 0."""
        if len(self) > CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        known, missed, found = self.__getitem__, self.missed, []
        for text in texts:
            if self.special(text) is not None:
                found.append((None, None, text))
                continue
            parts, before = _SPLIT(text) if _NOT_PLAIN(text) else _PLAIN_SPLIT(text), len(missed)
            ids = list(map(known, parts))
            found.append((parts, None, text) if len(missed) > before else (None, b"".join(ids), text))
        self._learn(set(missed))
        missed.clear()
        for parts, ids, text in found:
            if ids is None:
                ids = next(self._coded([text])) if parts is None else b"".join(map(known, parts))
            yield np.frombuffer(ids + b"\0\0\0\0", "<u4")


@lru_cache(maxsize=2)
def _tokens(path: str) -> DocumentTokens:
    return DocumentTokens(path)


# Characters of text tokenized at a time.
TEXT_BLOCK = 1 << 21


# Tokens of a document that wait as one example.
WINDOW = 1 << 14
#: Limits and loss law under which a corpus of documents is packed.
DOCUMENT_LIMITS, DOCUMENT_LOSS = Limits(tokens=1024, segments=4, loss_tokens=320), "first"


class Bearing:
    """Which ids of a document bear loss: ``all`` but the closing one, or of these only each id's
    ``first`` occurrence, so that repetition is read but not learned."""

    def __init__(self, law: str):
        if law not in ("all", "first"):
            raise ValueError(f"loss is 'all' or 'first', not {law!r}")
        self.law = law
        self.place = np.zeros(1, np.int32)

    def before(self, ids: np.ndarray) -> np.ndarray:
        """How many ids bear loss before each position, and in all."""
        n = len(ids) - 1
        bears = np.ones(n, bool)
        if self.law == "first" and n:
            if (top := int(ids.max())) >= len(self.place):
                self.place = np.zeros(top + 1, np.int32)
            order = np.arange(n, dtype=np.int32)
            # Written from the end, an id's place is its first one.
            self.place[ids[:n][::-1]] = order[::-1]
            bears = self.place[ids[:n]] == order
        out = np.zeros(n + 2, np.int32)
        np.cumsum(bears, out=out[1 : n + 1])
        out[n + 1] = out[n]
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, loss: str = "all") -> DataFrame:
    """Tokenize documents, close each with id 0, and pack them into sequences, cutting freely.

    One row per piece: the document's id, ``start``, ``length``, ``ids_crc32`` (of little-endian
    unsigned 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset``, ``segment``, ``n_loss`` and,
    if asked for, ``ids``. ``loss`` is the law of ``Bearing``. Null text is the empty text: one
    piece with the closing id. Repeated rows are separate documents; an empty table gives no rows.
    """
    Bearing(loss)  # a law that is unknown is reported here
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "n_loss"] + ["ids"] * with_ids
    types = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, bearing = _tokens(tokenizer_path), Packer(limits, cut=True), Bearing(loss)
        base, made = TaskContext.get().partitionId() << TASK_SHIFT, 0
        kind = pa.int64()

        def emit(sequences):
            nonlocal made
            rows = []
            for members in sequences:
                offset = 0
                for k, m in enumerate(members):
                    (doc, total, first, ids) = m.tag
                    own = ids[m.start - first : m.start - first + m.tokens]
                    row = (doc, m.start, m.tokens, zlib.crc32(own.tobytes()), total, base + made, offset, k, m.loss)
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)
                    offset += m.tokens
                made += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types[1:]], strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            closed, block, held = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                block.append((doc.as_py(), text.as_py() or ""))
                held += len(block[-1][1])
                if held >= TEXT_BLOCK:
                    for sequence in _placed(coder, packer, bearing, block):
                        closed.append(sequence)
                        if len(closed) >= 4096:
                            yield emit(closed)
                            closed = []
                    block, held = [], 0
            closed += _placed(coder, packer, bearing, block)
            yield emit(closed)
        yield emit(packer.finish())

    kind_name = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ["start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long", "segment int", "n_loss long"] + ["ids array<int>"] * with_ids
    return chosen.mapInArrow(run, ", ".join([f"id {kind_name}", *schema])).withColumnRenamed("id", id_col)


def _placed(coder: DocumentTokens, packer: Packer, bearing: Bearing, block: list) -> Iterator[list[Example]]:
    for (doc, _), ids in zip(block, coder.encode([t for _, t in block]), strict=True):
        before = bearing.before(ids)
        for at in range(0, len(ids), WINDOW):
            # What waits in the pool should not hold the long document that it belongs to.
            end = min(at + WINDOW, len(ids))
            own, marks = (ids, before) if end - at == len(ids) else (ids[at:end].copy(), before[at : end + 1].copy())
            yield from packer.add(Example((doc, len(ids), at, own), at, end - at, int(marks[-1] - marks[0]), marks, at))
