"""Byte-level BPE by longest matches and backtracking.

A piece's bytes are read as Latin-1, so that an Aho-Corasick automaton over the vocabulary
finds the longest token at every position in one scan. Tokens are then taken longest first; a
token is kept if BPE itself would leave the border to its left neighbour in place, else the next
shorter prefix is tried, and when none is left the neighbour is given back. Borders and dead ends
are remembered, so the work is linear in the piece.

Texts are cut into pieces by a pattern. Letters, digits and white space in it are those of the rank
files' own library, whose Unicode tables differ from this module's; the code points on which
they differ are found once in each worker.

Edge cases: null text is the empty text (no ids); a piece that is a token itself is that token,
as the rank files' own library has it; bytes without a token of their own cannot occur, as every
byte has one (checked when the file is read).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pieces in each of the two generations that a worker remembers.
CACHED_PIECES = 250_000
_NO_LIMIT = 1 << 40


class PieceEncoder:
    """The vocabulary of one rank file, its merges, and the encoder of single pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
            parts = [token] if len(token) == 1 else self._merge_below(token, rank)
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            elif len(parts) == 2:
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.halves[rank] = pair
                self.merged[pair] = rank
        # A token that no merge produces can only stand for a whole piece.
        self.automaton = ahocorasick.Automaton()
        for rank in self.halves:
            token = self.bytes_of[rank]
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.shorter = {rank: self._next_prefix(self.bytes_of[rank]) for rank in self.halves}
        self.borders: dict[tuple[int, int], bool] = {}

    def _merge_below(self, token: bytes, limit: int) -> list[bytes]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [
                (rank, i)
                for i in range(len(parts) - 1)
                if (rank := self.ranks.get(parts[i] + parts[i + 1], limit)) < limit
            ]
            if not found:
                return parts
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _next_prefix(self, token: bytes) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:end])
            if rank in self.halves:
                return rank
        return None

    def _keeps_border(self, left: int, right: int) -> bool:
        """Whether BPE, run over both tokens' bytes together, ends with these two tokens."""
        known = self.borders.get((left, right))
        if known is not None:
            return known
        a, b, below, kept = left, right, _NO_LIMIT, True
        while True:
            if self.merged.get((a, b), _NO_LIMIT) < below:
                kept = False
                break
            # Undo the later of the two merges that built the tokens at the border.
            if a > b and self.halves[a][1] != a:
                below, a = a, self.halves[a][1]
            elif self.halves[b][0] != b:
                below, b = b + 1, self.halves[b][0]
            elif self.halves[a][1] != a:
                below, a = a, self.halves[a][1]
            else:
                break
        if len(self.borders) >= 2_000_000:
            self.borders.clear()
        self.borders[left, right] = kept
        return kept

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        size = len(piece)
        longest: list[int] = [-1] * size
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = rank  # ends come in order: the last is the longest
        dead = bytearray(size + 1)
        taken: list[int] = []
        at = 0
        token: int | None = longest[0] if size else None
        while at < size:
            before = taken[-1] if taken else None
            while token is not None:
                end = at + len(self.bytes_of[token])
                if not dead[end] and (before is None or self._keeps_border(before, token)):
                    break
                token = self.shorter[token]
            if token is None:
                dead[at] = 1
                token = taken.pop()
                at -= len(self.bytes_of[token])
                end = at + len(self.bytes_of[token])
                continue
            taken.append(token)
            at = end
            token = longest[at] if at < size else None
        return tuple(taken)


# The classes that patterns name, in the order they are looked up, with a member that both
# libraries agree on and no pattern names; and one that is in none of them.
_CLASSES = ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", "\u2003"))
_OTHER = "\ufffd"


@lru_cache(maxsize=1)
def class_differences() -> dict[int, str]:
    """Code points that the rank files' library has in another class, with a stand-in of that class."""
    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    singles = {bytes([b]): b for b in range(256)}
    own: dict[str, str] = {}
    theirs: dict[str, str] = {}
    for pattern, member in _CLASSES:
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=singles, special_tokens={})
        theirs.update(dict.fromkeys(bytes(library.encode_ordinary(everything)).decode(), member))
        own.update(dict.fromkeys(regex.findall(pattern, everything), member))
    return {ord(c): theirs.get(c, _OTHER) for c in own.keys() | theirs.keys() if own.get(c) != theirs.get(c)}


class Splitter:
    """Pieces of texts by a pattern over letters, digits, white space and ASCII characters."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.stand_ins = class_differences()
        self.odd = frozenset(map(chr, self.stand_ins))
        # One range is a fast first test: most texts have no code point that could be among them.
        self.high = re.compile(f"[{min(self.odd)}-\U0010ffff]").search if self.odd else lambda text: None

    def pieces(self, text: str) -> list[str]:
        if self.high(text) is None or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        # Every stand-in is one code point too, so places in both texts are the same.
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]


class TextEncoder(dict):
    """Ids of pieces by their text, computed when first asked for.

    Pieces are kept in two generations: a full one becomes the old one, and what is asked for
    again moves back, so frequent pieces stay and memory stays bounded.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.old: dict[str, tuple[int, ...]] = {}
        self.pieces = PieceEncoder(ranks)
        self.split = Splitter(pattern).pieces
        self.token_bytes = self.pieces.bytes_of.__getitem__

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.pieces.encode(piece.encode())
        self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self) > CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``ids`` (array<int>). Null text gives no ids.

    ``ranks_path`` is the vocabulary's place on every machine. Only the two named columns are
    read; a row is encoded alone, so any order, repetition or length of rows will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ids: the id and ``content`` (binary). Null or no ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_table(ranks_path).__getitem__
        for batch in batches:
            content = [b"".join(map(table, x.as_py() or ())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["id", "content"])

    kind = encoded.schema[id_col].dataType.simpleString()
    chosen = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(run, f"id {kind}, content binary").withColumnRenamed("id", id_col)


@lru_cache(maxsize=2)
def _token_table(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of both directions per document: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Encodes, then decodes the ids, in one pass over the texts, so that ids never leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        decimal = {rank: str(rank) for rank in encoder.pieces.bytes_of}.__getitem__
        for batch in batches:
            counts, written, decoded = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                counts.append(len(ids))
                written.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    digests = chosen.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return digests.withColumnRenamed("id", id_col)
