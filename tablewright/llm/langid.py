"""Language of texts by n-gram filters that answer for all languages at once.

Training counts, for each language, in how many documents each n-gram of bytes occurs. N-grams
with at least a ``share`` of a language's counts belong to its set, so a set has at most 1 / share
members however large the corpus. All sets go into one bit-sliced Bloom filter: a row of the filter
has one bit per language, an n-gram's rows are joined by AND, and what is left are the languages
that may hold it. A text's n-grams are looked up, its hits are counted per language, and the hits
expected from false positives alone are taken off. The language whose own texts would show the
most similar share of hits has the text.

N-grams lie inside words: texts are lower-cased, everything in ASCII that is no letter becomes a
single space, and an n-gram may begin or end with a space but holds none in between.

Null text, or text without a letter, is ``und`` with a score of 0, and so is every text if nothing
has been learnt. Text with letters but no hit at all has the language of the most training
documents, with a score of 0. Equal languages give the first by name. Texts of any length are read whole; rows that
repeat count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.words import U64, mix, slices
from tablewright.session import cut_lineage

UNDETERMINED = "und"
_SPACE = np.ones(256, bool)
_SPACE[ord("a") : ord("z") + 1] = False
_SPACE[0x80:] = False
_LETTER = regex.compile(r"\p{L}")
# Counts that a task holds before it merges and passes them on.
_HELD = 2_000_000


@dataclass(frozen=True)
class LanguagePlan:
    """``sizes``: bytes of an n-gram, at most 4. ``rows_per_gram`` and ``probes`` make the filter.

    ``languages`` bounds the width of the filter; more are refused, not dropped.
    """

    sizes: tuple[int, ...] = (2, 3, 4)
    share: float = 3e-5
    probes: int = 3
    rows_per_gram: int = 16
    languages: int = 1024


class NgramFilter:
    """One Bloom filter per language, kept by position: row i has bit i of every filter."""

    def __init__(self, grams: np.ndarray, language: np.ndarray, languages: int, plan: LanguagePlan):
        largest = int(np.bincount(language, minlength=languages).max(initial=1))
        self.rows = 1 << max(10, (plan.rows_per_gram * largest - 1).bit_length())
        self.probes, self.languages = plan.probes, languages
        self.planes = np.zeros((-(-languages // 8), self.rows), np.uint8)
        for place in self._places(grams):
            np.bitwise_or.at(self.planes, (language >> 3, place), (1 << (language & 7)).astype(np.uint8))
        filled = np.stack([np.count_nonzero(self.planes[k >> 3] & (1 << (k & 7))) for k in range(languages)])
        #: How often a filter says yes to an n-gram that it does not hold.
        self.false_positives = (filled / self.rows) ** plan.probes

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(grams)
        step = mix(h ^ U64(0xA5A5A5A5A5A5A5A5)) | U64(1)
        for _ in range(self.probes):
            yield (h & U64(self.rows - 1)).astype(np.int64)
            h = h + step

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that may hold each n-gram, as bytes of eight languages each."""
        found = None
        for place in self._places(grams):
            rows = self.planes[:, place]
            found = rows if found is None else found & rows
        return found

    def hits(self, grams: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Popcounts per owner (text) and language."""
        masks = self.masks(grams)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        out = []
        for plane in masks:
            # Equal masks of a text are counted together before their bits are.
            kinds = np.bincount(owner * 256 + plane, minlength=owners * 256).reshape(owners, 256)
            out.append(kinds @ bits)
        return np.concatenate(out, axis=1)[:, : self.languages]

    def corrected(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Hits less what false positives alone would add; never negative."""
        p = self.false_positives
        return np.maximum((hits - total[:, None] * p) / np.maximum(1 - p, 1e-9), 0)


@dataclass
class LanguageModel:
    """What training leaves: names, the filter, each language's share of hits in its own texts."""

    names: list[str]
    filter: NgramFilter | None
    coverage: np.ndarray
    usual: int
    plan: LanguagePlan


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as words between single spaces, and the place of the space before each text."""
    parts = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    space = _SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    borders = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])[:-1]
    starts = np.cumsum(keep)[borders] - 1
    return np.where(space, np.uint8(0x20), data)[keep], starts


def ngrams(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of a size as a number, and the text it is in."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    value = np.full(n, size, U64)
    whole = np.ones(n, bool)
    for k in range(size):
        piece = data[k : k + n]
        value = (value << U64(8)) | piece
        if 0 < k < size - 1:
            whole &= piece != 0x20
    at = np.flatnonzero(whole)
    return value[at], np.searchsorted(starts, at, side="right") - 1


def _training_rows(docs: DataFrame, train: Column, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def gram_counts(rows: DataFrame, plan: LanguagePlan) -> DataFrame:
    """Per language and n-gram: the number of documents that have it. ``rows``: lang, text."""
    sizes = plan.sizes

    def merged(held: list[tuple[str, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for name in sorted({h[0] for h in held}):
            grams = np.concatenate([h[1] for h in held if h[0] == name])
            n = np.concatenate([h[2] for h in held if h[0] == name])
            grams, place = np.unique(grams, return_inverse=True)
            n = np.bincount(place, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for part in slices(batch):
                langs = part.column(0).dictionary_encode()
                code = np.asarray(langs.indices)
                data, starts = normalised(pc.fill_null(part.column(1), "").to_pylist())
                for size in sizes:
                    grams, owner = ngrams(data, starts, size)
                    # Five bytes at most: the text's place in the part fits above them.
                    once = np.unique((owner.astype(U64) << U64(40)) | grams)
                    own = code[(once >> U64(40)).astype(np.int64)]
                    for k, name in enumerate(langs.dictionary.to_pylist()):
                        found, n = np.unique(once[own == k] & U64((1 << 40) - 1), return_counts=True)
                        held.append((name, found, n))
                        waiting += len(found)
                if waiting > _HELD:
                    yield from merged(held)
                    held, waiting = [], 0
        yield from merged(held)

    counted = rows.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train: Column, plan: LanguagePlan = LanguagePlan(), text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of all languages in the rows where ``train`` holds and the language is not null."""
    rows = _training_rows(docs, train, text_col, lang_col)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(plan.languages + 1).collect()}
    if len(sizes) > plan.languages:
        raise ValueError(f"more than {plan.languages} languages: raise LanguagePlan.languages")
    names = sorted(sizes)
    counts = cut_lineage(gram_counts(rows, plan))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageModel(names, None, np.zeros(len(names)), 0, plan)
    # At most 1 / share n-grams of each language come to the driver.
    least = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, n * plan.share)])
    chosen = counts.where(F.col("n") >= F.element_at(least, F.col("lang"))).toPandas()
    language = chosen["lang"].map({name: k for k, name in enumerate(names)}).to_numpy(np.int64)
    grams = chosen["gram"].to_numpy(np.int64).view(U64)
    held = np.bincount(language, chosen["n"].to_numpy(float), len(names))
    coverage = held / np.array([max(totals.get(name, 0), 1) for name in names])
    usual = max(range(len(names)), key=lambda k: (sizes[names[k]], -k))
    return LanguageModel(names, NgramFilter(grams, language, len(names), plan), coverage, usual, plan)


def judge(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if model.filter is None:
        has = [_LETTER.search(t) is not None for t in texts] if model.names else [False] * len(texts)
        return [model.names[model.usual] if h else UNDETERMINED for h in has], np.zeros(len(texts))
    data, starts = normalised(texts)
    hits = np.zeros((len(texts), len(model.names)))
    total = np.zeros(len(texts))
    for size in model.plan.sizes:
        grams, owner = ngrams(data, starts, size)
        hits += model.filter.hits(grams, owner, len(texts))
        total += np.bincount(owner, minlength=len(texts))
    likeness = model.filter.corrected(hits, total) / np.maximum(total[:, None] * np.maximum(model.coverage, 1e-9), 1e-9)
    best = likeness.argmax(axis=1)
    score = np.clip(likeness[np.arange(len(texts)), best], 0, 1)
    best[score == 0] = model.usual
    lettered = np.array([_LETTER.search(t) is not None for t in texts], bool)
    return [model.names[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered, strict=True)], np.where(lettered, score, 0.0)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``lang_pred``, ``score`` (0 to 1). Only the two named columns are read."""
    # The filter has at most languages / share * rows_per_gram * 2 bits, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, score = judge(pc.fill_null(part.column(1), "").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
