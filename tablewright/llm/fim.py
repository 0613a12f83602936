"""Texts rearranged for training models to fill in a middle.

A text is cut at two borders of units (words with the white space before them, or lines) that are
drawn from a hash of its id, and its three pieces are written as prefix, suffix, middle or suffix,
prefix, middle behind sentinels. All texts of a part of a batch make one wavelet matrix over the
classes of their bytes: ranks of the classes that end a unit add up to counts of borders, and
bisection on these ranks finds both cuts of all texts at once. Ranks of continuation bytes turn
places into code points.

Null text is the empty text. A text that is empty or holds a sentinel stays plain, so that every
output can be taken back exactly. Rows that share an id share its draws; a null id draws as the
empty string does. Texts of any length are cut whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.wavelet import WaveletMatrix
from tablewright.llm.words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Classes of bytes: inside a word or its last byte, each as first or later byte of a character;
# white space other than a line break, and line breaks.
INSIDE, INSIDE_LATER, LAST, LAST_LATER, SPACE, BREAK = range(6)
#: The classes that end a unit; what follows the last of them is a unit too.
UNITS = {"word": (LAST, LAST_LATER), "line": (BREAK,)}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class FimPlan:
    """``percent`` of the texts are rearranged, ``suffix_first_percent`` of these with the suffix first."""

    seed: int = 42
    percent: int = 50
    suffix_first_percent: int = 80
    unit: str = "word"


def byte_classes(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Class of each byte; ``borders`` are the places where texts begin and end."""
    if not len(data):
        return np.zeros(0, np.uint8)
    space = _IS_SPACE[data]
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    ends = borders[borders > 0] - 1
    last[ends] = True
    classes = 2 * last.astype(np.uint8) + ((data & 0xC0) == 0x80)
    classes[space] = SPACE
    classes[data == 0x0A] = BREAK
    return classes


def draws(name: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for an id."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def _form(text: bytes, h3: int, h4: int, plan: FimPlan) -> str:
    marked = any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h3 % 100 >= plan.percent:
        return "plain"
    return "spm" if h4 % 100 < plan.suffix_first_percent else "psm"


def cut_texts(texts: pa.Array, names: list[str], plan: FimPlan):
    """Per text: number of units, form, code points of prefix and middle (None if plain), output."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[borders[0] : borders[-1]] if raw is not None else np.zeros(0, np.uint8)
    borders = borders - borders[0]
    matrix = WaveletMatrix(byte_classes(data, borders), 3)
    ends, later = UNITS[plan.unit], (INSIDE_LATER, LAST_LATER)
    start, stop = borders[:-1], borders[1:]
    counted = matrix.rank_any(ends, borders)
    before = counted[:-1]
    # A unit that is not ended by its class is ended by the text.
    found = matrix.place_any(ends, counted[1:], start, stop)
    units = counted[1:] - before + ((stop > start) & (found < stop))
    drawn = [draws(name, plan.seed) for name in names]
    first = np.array([min(h[0] % (n + 1), h[1] % (n + 1)) for h, n in zip(drawn, units.tolist(), strict=True)], np.int64)
    second = np.array([max(h[0] % (n + 1), h[1] % (n + 1)) for h, n in zip(drawn, units.tolist(), strict=True)], np.int64)
    cut_a = matrix.place_any(ends, before + first, start, stop)
    cut_b = matrix.place_any(ends, before + second, start, stop)
    points = lambda a, b: b - a - (matrix.rank_any(later, b) - matrix.rank_any(later, a))
    prefix_chars, middle_chars = points(start, cut_a).tolist(), points(cut_a, cut_b).tolist()
    whole = data.tobytes()
    for i, (a, x, y, z) in enumerate(zip(start.tolist(), cut_a.tolist(), cut_b.tolist(), stop.tolist(), strict=True)):
        text = whole[a:z]
        form = _form(text, *drawn[i][2:], plan)
        if form == "plain":
            yield int(units[i]), form, None, None, text
            continue
        prefix, middle, suffix = PREFIX.encode() + whole[a:x], MIDDLE.encode() + whole[x:y], SUFFIX.encode() + whole[y:z]
        output = prefix + suffix + middle if form == "psm" else suffix + prefix + middle
        yield int(units[i]), form, prefix_chars[i], middle_chars[i], output


def transform(docs: DataFrame, plan: FimPlan = FimPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``form`` is ``plain`` (the output is the text), ``psm`` or ``spm``. Only the two named columns
    are read, and every row is handled alone, in parts of a batch bounded by bytes.
    """
    if plan.unit not in UNITS:
        raise ValueError(f"unit has to be one of {sorted(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names = [x or "" for x in part.column(2).to_pylist()]
                n, form, prefix, middle, output = zip(*cut_texts(part.column(1), names, plan), strict=True)
                columns = [
                    part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("name"))
    moved = chosen.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return moved.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. No text in it holds a sentinel."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def parted(first: str, second: str) -> tuple[Column, Column]:
        return F.substring_index(F.substring_index(head, second, 1), first, -1), F.substring_index(head, second, -1)

    prefix, suffix = parted(PREFIX, SUFFIX)
    suffix_first, prefix_second = parted(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_second, middle, suffix_first)).otherwise(output)


def digests(docs: DataFrame, plan: FimPlan = FimPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``transform`` with ``output_sha256`` and ``restored_sha256`` in place of the output."""
    moved = transform(docs, plan, id_col, text_col)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return moved.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def oracle() -> str:
    """The same rows in SQL."""
    return r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(tokens) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(tokens) + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM cut),
pieces AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain'
      WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tokens[1:least(a, b)], '') AS prefix,
    array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(tokens[greatest(a, b) + 1:], '') AS suffix
  FROM drawn),
written AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM pieces)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM written"""
