"""Toxic spans by a linear-chain conditional random field.

A token's features are the word itself, its first 3 to 6 bytes and its last 4, so that unseen
inflections are recognised. Labels are of whole documents, so token labels are derived first: from
a bounded sample of labelled documents, features that are much likelier in toxic than in other
documents are candidates, and a greedy cover picks the few that explain the toxic documents (most
copies of one text are left out, so what a much-copied document holds does not pass as evidence).
Tokens of toxic documents with a picked feature are labelled toxic, all others are not. The field
has a weight per candidate feature, one for all other tokens, and transitions; it is trained by
gradient ascent on windows of the sample.

Scoring is one scan. Between tokens with candidate features potentials are constant, so the chain is stepped
over with powers of one 2 x 2 matrix: exact forward-backward marginals at the cost of the hits
alone, for all texts of a batch at once. A document's score combines its tokens' marginals (that any of them is toxic) and is
calibrated on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.words import PUNCTUATION, U64, buffers, mix, slices, word_hashes, word_spans
from tablewright.session import cut_lineage


@dataclass(frozen=True)
class FitPlan:
    """Bounds of the fit: labelled documents per class, candidate features, windows, steps.

    A candidate has ``support`` toxic texts, and its log-odds are ``z`` standard errors above 0,
    however small they are. All sampled documents have equal shares of the ``windows``: four at
    most, and one at least.
    """

    documents: int = 4000
    candidates: int = 8192
    support: int = 3
    z: float = 2.5
    window: int = 6
    windows: int = 16_000
    steps: int = 120
    ridge: float = 0.02


@dataclass
class Model:
    """Sorted feature hashes, their weights for the toxic state, and what holds for all others."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other: float = -4.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0


# Byte lengths of the prefixes that are features; the suffix has the last one's.
PREFIXES, SUFFIX = (3, 4, 5, 6), 4


def _tokens(texts: pa.Array):
    """Bytes and borders, spans of tokens, tokens before each text, and features by kind (0: none)."""
    data, borders = buffers(texts)
    starts, ends, counts = word_spans(data, borders, PUNCTUATION)
    hashes = word_hashes(data, starts, ends)
    length = ends - starts
    kinds = [hashes]
    for k in PREFIXES:
        kinds.append(np.where(length > k, word_hashes(data, starts, starts + np.minimum(length, k)) ^ U64(k << 56), U64(0)))
    tail = np.maximum(ends - SUFFIX, starts)
    kinds.append(np.where(length > SUFFIX, word_hashes(data, tail, ends) ^ U64(0x99 << 56), U64(0)))
    return data, borders, starts, ends, counts, kinds


def _hits(kinds: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with candidate features, by place, and which features; a token appears once for each."""
    if not len(words) or not len(kinds[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.zeros(1 << 18, bool)
    table[(words & U64(0x3FFFF)).astype(np.int64)] = True
    places, which = [], []
    for hashes in kinds:
        maybe = np.flatnonzero(table[(hashes & U64(0x3FFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(words, hashes[maybe]), len(words) - 1)
        same = (words[at] == hashes[maybe]) & (hashes[maybe] != U64(0))
        places.append(maybe[same])
        which.append(at[same])
    places, which = np.concatenate(places), np.concatenate(which)
    order = np.argsort(places, kind="stable")
    return places[order], which[order]


def sample(labels: DataFrame, learns: Column, plan: FitPlan, id_col: str, label_col: str) -> DataFrame:
    """At most ``plan.documents`` ids of each class, those with the smallest hashes."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(learns)
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    first = lambda toxic: own.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(plan.documents)
    return first(1).unionByName(first(0))


def fit(docs: DataFrame, labels: DataFrame, learns: Column, plan: FitPlan = FitPlan(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on labelled documents where ``learns`` (a column of the labels) holds.

    Null labels or ids are left out, a document labelled twice is toxic if one label says so.
    Without toxic or without other documents the model scores everything alike.
    """
    # The broadcast side has at most twice plan.documents rows.
    chosen = F.broadcast(cut_lineage(sample(labels, learns, plan, id_col, label_col)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("id", "text", "toxic")

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                *_, counts, kinds = _tokens(part.column(1))
                found = [_family(kinds[0][a:b]) for a, b in zip(counts[:-1], counts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(found, pa.int64())], ["text", "toxic", "family"])

    rows = rows.mapInArrow(families, "text string, toxic int, family long")
    rows = cut_lineage(rows.dropDuplicates(["family", "toxic"]))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=0):
                *_, counts, kinds = _tokens(part.column(0))
                own = [np.unique(np.concatenate([k[a:b] for k in kinds])) for a, b in zip(counts[:-1], counts[1:], strict=True)]
                toxic = np.repeat(np.asarray(part.column(1)), [len(x) for x in own])
                words, at = np.unique(np.concatenate(own), return_inverse=True)
                t = np.bincount(at, toxic, len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(t), pa.array(np.bincount(at, 1 - toxic, len(words)).astype(np.int64))], ["word", "t", "c"])

    counted = rows.mapInArrow(occurrences, "word long, t long, c long").where("word <> 0").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("family").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    odds = F.log((F.col("t") + 0.5) / (sizes[1] + 1)) - F.log((F.col("c") + 0.5) / (sizes[0] + 1))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counted.where(F.col("t") >= plan.support).withColumn("z", z).where(F.col("z") >= plan.z).orderBy(F.desc("z"), "word").limit(plan.candidates).collect()
    best = sorted(best, key=lambda r: r.word % (1 << 64))
    words = np.array([r.word for r in best], np.int64).view(U64)

    def held(part: pa.RecordBatch):
        *_, counts, kinds = _tokens(part.column(0))
        at, which = _hits(kinds, words)
        cut = np.searchsorted(at, counts)
        return np.diff(counts), cut, at - np.repeat(counts[:-1], np.diff(cut)), which

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=0):
                _, cut, _, which = held(part)
                own = [np.unique(which[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(own, pa.list_(pa.int64()))], ["toxic", "family", "which"])

    found = rows.mapInArrow(features, "toxic int, family long, which array<long>").collect()
    picked = _cover(found, np.array([r.t for r in best]), np.array([r.c for r in best]), plan)
    if not picked.any():
        return Model()
    share = max(1, min(4, plan.windows // len(found)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = pa.list_(pa.int32())
        for batch in batches:
            for part in slices(batch, column=0):
                lengths, cut, at, which = held(part)
                toxic, family, out = np.asarray(part.column(1)), np.asarray(part.column(2)), []
                for d in np.flatnonzero(lengths):
                    hit = slice(cut[d], cut[d + 1])
                    for k, (kinds, states) in enumerate(_document_windows(int(lengths[d]), at[hit], which[hit], picked & bool(toxic[d]), plan.window, share)):
                        out.append((family[d], toxic[d], k, kinds.ravel(), states))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], small), pa.array(columns[4], small)], ["family", "toxic", "k", "kinds", "states"])

    cutouts = rows.mapInArrow(windows, "family long, toxic int, k int, kinds array<int>, states array<int>").collect()
    cutouts.sort(key=lambda r: (r.family, r.toxic, r.k))  # the same sums in every run
    if not cutouts:
        return Model()
    width = len(PREFIXES) + 2
    model = _train(np.array([r.kinds for r in cutouts]).reshape(len(cutouts), -1, width), np.array([r.states for r in cutouts]), words, plan)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=0):
                value = _chains(model, *held(part))[0]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(value)], ["family", "toxic", "raw"])

    scores = sorted(tuple(r) for r in rows.mapInArrow(raw, "family long, toxic int, raw double").collect())
    model.slope, model.shift = _calibrate(np.array([r[2] for r in scores]), np.array([r[1] for r in scores]))
    return model


def _family(hashes: np.ndarray) -> int:
    """The same number for most copies of a text: its smallest three-word shingle."""
    if len(hashes) < 3:
        return int(np.int64(hashes.sum(dtype=U64).view(np.int64))) if len(hashes) else 0
    return int(mix(hashes[:-2] + hashes[1:-1] * U64(3) + hashes[2:] * U64(5)).min().view(np.int64))


def _cover(found, t: np.ndarray, c: np.ndarray, plan: FitPlan) -> np.ndarray:
    """Features picked one by one, each explaining the most toxic texts that none explains yet.

    What often stands in toxic texts and never in others is picked as well.
    """
    holders: dict[int, set[int]] = {}
    for r in found:
        if r.toxic:
            for w in set(r.which):
                holders.setdefault(w, set()).add(r.family)
    picked = (c == 0) & (t >= 10 * plan.support)
    covered = set().union(*(holders.get(w, set()) for w in np.flatnonzero(picked).tolist()))
    holders = {w: left for w, v in holders.items() if not picked[w] and len(left := v - covered) >= plan.support}
    while holders:
        w = max(sorted(holders), key=lambda w: len(holders[w]) - 2 * int(c[w]))
        if len(holders[w]) - 2 * int(c[w]) < plan.support:
            break
        picked[w] = True
        done = holders.pop(w)
        holders = {k: left for k, v in holders.items() if len(left := v - done) >= plan.support}
    return picked


def _document_windows(n: int, at: np.ndarray, which: np.ndarray, picked: np.ndarray, window: int, share: int):
    """At most ``share`` windows around places with features, spread over a text of ``n`` tokens.

    Each is an array of features by token (the word's place first: ``len(picked)`` for a token
    without any, one more beyond the text; ``len(picked) + 5`` for no more features) and the states.
    """
    size, width = 2 * window + 1, len(PREFIXES) + 2
    other, beyond, none = len(picked), len(picked) + 1, len(picked) + 5
    tokens = np.unique(at)
    for k in range(max(1, min(len(tokens), share))):
        centre = tokens[k * max(1, len(tokens) // share)] if len(tokens) else n // 2
        row = np.full((size, width), none, np.int64)
        inside = np.arange(size) + centre - window
        row[:, 0] = np.where((inside >= 0) & (inside < n), other, beyond)
        states, used = np.zeros(size, np.int64), np.ones(size, np.int64)
        near = slice(*np.searchsorted(at, [centre - window, centre + window + 1]))
        for place, feature in zip(at[near] - centre + window, which[near], strict=True):
            if row[place, 0] == other:
                row[place, 0] = feature
            else:
                row[place, used[place]] = feature
                used[place] += 1
            states[place] |= int(picked[feature])
        yield row, states


def _train(kinds: np.ndarray, labels: np.ndarray, words: np.ndarray, plan: FitPlan) -> Model:
    """Gradient ascent (Adam) on the mean log-likelihood of windows around candidate words."""
    width, n_words = kinds.shape[2], len(words)
    beyond, other, none = n_words + 1, n_words, n_words + 5
    real = kinds[:, :, 0] != beyond
    both = real[:, 1:] & real[:, :-1]
    # Weights of features, of all other tokens, four transitions, and one that stays zero.
    theta, m, v = np.zeros(none + 1), np.zeros(none + 1), np.zeros(none + 1)
    theta[other] = -2.0
    for step in range(1, plan.steps + 1):
        emit = np.where(real, theta[kinds].sum(axis=2), 0.0)
        marginal, pair = _windows(emit, theta[beyond:none].reshape(2, 2), real)
        grad = np.bincount(kinds[real].ravel(), np.repeat((labels - marginal)[real], width), none + 1)
        for a in range(2):
            for b in range(2):
                truth = (labels[:, :-1] == a) & (labels[:, 1:] == b)
                grad[beyond + 2 * a + b] = truth[both].sum() - pair[:, :, a, b][both].sum()
        grad = grad / len(kinds) - plan.ridge * theta / len(kinds) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[none] = 0.0
    return Model(words, theta[:n_words], float(theta[other]), theta[beyond:none].reshape(2, 2))


def _windows(emit: np.ndarray, trans: np.ndarray, real: np.ndarray):
    """Marginals of the toxic state and of neighbouring states, for rows of equal length."""
    n, size = emit.shape
    step = np.exp(trans)
    potential = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
    potential[~real] = 1.0
    forward, backward = np.zeros((n, size, 2)), np.ones((n, size, 2))
    forward[:, 0] = potential[:, 0]
    for t in range(1, size):
        moved = np.where((real[:, t] & real[:, t - 1])[:, None], forward[:, t - 1] @ step, forward[:, t - 1].sum(axis=1, keepdims=True))
        forward[:, t] = moved * potential[:, t]
        forward[:, t] /= forward[:, t].sum(axis=1, keepdims=True)
    for t in range(size - 2, -1, -1):
        onward = potential[:, t + 1] * backward[:, t + 1]
        moved = np.where((real[:, t] & real[:, t + 1])[:, None], onward @ step.T, onward.sum(axis=1, keepdims=True))
        backward[:, t] = moved / moved.sum(axis=1, keepdims=True)
    both = forward * backward
    marginal = both[:, :, 1] / both.sum(axis=2)
    pair = forward[:, :-1, :, None] * step * (potential[:, 1:] * backward[:, 1:])[:, :, None, :]
    return marginal, pair / pair.sum(axis=(2, 3), keepdims=True)


def _calibrate(raw: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the raw scores' log-odds, lightly regularised."""
    x, y = _logit(raw), toxic.astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - (a - 0.5), (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 1.0, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a + np.clip(move[0], -0.5, 0.5), b + np.clip(move[1], -1, 1)
    return max(float(a), 1e-3), float(b)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _raw(model: Model, n: int, at: np.ndarray, which: np.ndarray) -> tuple[float, np.ndarray]:
    """What ``_chains`` gives for one text: its raw score and its marginals."""
    raw, marginal, _, _ = _chains(model, np.array([n]), np.array([0, len(at)]), at, which)
    return float(raw[0]), marginal


def _chains(model: Model, lengths: np.ndarray, cut: np.ndarray, at: np.ndarray, which: np.ndarray):
    """Marginals of all texts of a batch: ``lengths`` in tokens, hits of text d in ``cut[d]:cut[d + 1]``.

    Returns for each text that any token with a candidate feature is toxic, and for each such token
    its marginal, its text and its place. Exact: one matrix leads from a hit to the next one, and
    the first of a text forgets what was before, so the batch is one chain.
    """
    text = np.repeat(np.arange(len(lengths)), np.diff(cut))
    if not len(text):
        return np.zeros(len(lengths)), np.zeros(0), text, at
    new = np.ones(len(at), bool)  # a token's features stand together
    new[1:] = (np.diff(at) != 0) | (np.diff(text) != 0)
    weights, at, text = np.add.reduceat(model.weights[which], np.flatnonzero(new)), at[new], text[new]
    start = np.diff(text, prepend=-1) != 0
    last = np.append(start[1:], True)
    moves, other = np.exp(model.transitions), np.array([1.0, np.exp(model.other)])
    own = np.stack([np.ones(len(at)), np.exp(np.clip(weights, -30, 30))], axis=1)
    before = np.where(start, at, np.diff(at, prepend=0)) - 1
    onward = (_powers(moves * other, np.maximum(before, 0)) @ moves) * own[:, None, :]
    entry = np.where(at[:, None] > 0, (other @ _powers(moves * other, np.maximum(before, 0))) @ moves, 1.0) * own
    forward = _walk(np.where(start[:, None, None], entry[:, None, :], onward))
    rest = _powers(moves * other, np.maximum(lengths[text] - 1 - at, 0)).sum(axis=2)
    back = np.empty_like(onward)
    back[:-1] = onward[1:].transpose(0, 2, 1)
    back[last] = rest[last][:, None, :]
    both = forward * _walk(back[::-1])[::-1]
    both /= both.sum(axis=1, keepdims=True)
    clean = np.bincount(text, np.log(np.maximum(both[:, 0], 1e-300)), len(lengths))
    return -np.expm1(clean), both[:, 1], text, at


def _powers(step: np.ndarray, k: np.ndarray) -> np.ndarray:
    """``step`` to the powers ``k``, up to a factor: a positive 2 x 2 matrix has two real eigenvalues."""
    (a, b), (c, d) = step
    gap = ((a - d) ** 2 + 4 * b * c) ** 0.5
    large, small = (a + d + gap) / 2, (a + d - gap) / 2
    first = (step - small * np.eye(2)) / gap
    return np.maximum(first + ((small / large) ** k)[:, None, None] * (np.eye(2) - first), 0.0)


def _walk(steps: np.ndarray) -> np.ndarray:
    """States (rows that add up to 1) after each matrix of a chain whose first one has equal rows.

    The chain is cut into blocks; all are stepped through side by side, first for their products,
    then from the states at their starts.
    """
    n = len(steps)
    width = int(n**0.5) + 1
    blocks = -(-n // width)
    m = np.tile(np.eye(2), (blocks * width, 1, 1))
    m[:n] = steps
    m /= m.sum(axis=(1, 2), keepdims=True)
    a, b, c, d = (np.ascontiguousarray(x) for x in m.reshape(blocks, width, 4).transpose(2, 1, 0))
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for j in range(width):
        p, q, r, s = p * a[j] + q * c[j], p * b[j] + q * d[j], r * a[j] + s * c[j], r * b[j] + s * d[j]
        total = p + q + r + s
        p, q, r, s = p / total, q / total, r / total, s / total
    x, y, heads = 0.5, 0.5, []
    for k in range(blocks):
        heads.append((x, y))
        x, y = x * p[k] + y * r[k], x * q[k] + y * s[k]
        x, y = x / (x + y), y / (x + y)
    x, y = np.array(heads).T
    out = np.empty((width, blocks, 2))
    for j in range(width):
        x, y = x * a[j] + y * c[j], x * b[j] + y * d[j]
        total = x + y
        x, y = x / total, y / total
        out[j, :, 0], out[j, :, 1] = x, y
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


def _scored(texts: pa.Array, model: Model, span_probability: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and toxic spans of each text."""
    data, borders, starts, ends, counts, kinds = _tokens(texts)
    at, which = _hits(kinds, model.words)
    cut = np.searchsorted(at, counts)
    raw, marginal, text, place = _chains(model, np.diff(counts), cut, at - np.repeat(counts[:-1], np.diff(cut)), which)
    spans: list[list[dict]] = [[] for _ in raw]
    upto, seen, before = 0, 0, -1  # code points of the text before the byte ``seen``
    for k in np.flatnonzero(marginal >= span_probability):
        d, token = text[k], counts[text[k]] + place[k]
        if d != before:
            upto, seen, before = 0, borders[d], d
        upto += _points(data[seen : starts[token]])
        size = _points(data[starts[token] : ends[token]])
        spans[d].append({"start": upto, "end": upto + size, "probability": float(marginal[k])})
        upto, seen = upto + size, ends[token]
    return 1 / (1 + np.exp(-np.clip(model.slope * _logit(raw) + model.shift, -40, 40))), spans


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", span_probability: float = 0.5) -> DataFrame:
    """One row per row: id, ``score`` (0 to 1) and ``spans`` (start, end in code points, probability)
    of the words that are likelier toxic than not.

    Null and empty texts have the score of a text without any candidate word. Repeated rows are
    scored alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
        for batch in batches:
            for part in slices(batch):
                value, spans = _scored(part.column(1), model, span_probability)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array(spans, pa.list_(span))], ["id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = chosen.mapInArrow(run, f"id {kind}, score double, spans array<struct<start: long, end: long, probability: double>>")
    return scored.withColumnRenamed("id", id_col)


def keep_below(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose texts score below the threshold, with all their columns and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for part in slices(batch, column=place):
                value, _ = _scored(part.column(place), model, 2.0)
                yield part.filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))
