"""Personal data: exact base patterns, and weakly supervised further spans.

Base spans (e-mail, IP, card, phone) are what their patterns say and always stay. Further
candidates (secrets and keys, written-out e-mails, local phone numbers, long numbers) are judged
by labelers that vote yes, no or nothing: shapes, word lists, and the words around. One scan counts
how often each combination of kind, votes and features occurs in all texts; expectation
maximisation over these counts estimates how reliable each labeler is and how likely a combination
is personal, with no labelled data; a logistic classifier over the features is trained on those
likelihoods and decides. A second scan applies it. The driver only sees counts of combinations,
whose number the features bound.

Every pattern takes time linear in the text, also on hostile input.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "number", "secret", "spelled_email")
KINDS = BASE + ADDED

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_ASSIGNED = re.compile(r"[=:]").finditer
_NAME = re.compile(r"([A-Za-z_-]{2,24})[\"']? {0,2}$").search
_OPENED = re.compile(r" {0,2}[\"']?").match
_VALUE = re.compile(r"[^\s\"',;]*+").match
_DIGITS = re.compile(r"[0-9]++").finditer
_KEY_TAIL = re.compile(r"[A-Za-z0-9_-]*+").match
_KEY_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
_SPELLED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}").finditer
_SPELLED_HINT = re.compile(r"[(\[ ]dot[)\] ]").search
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])").match

# Labelers look at this many characters of a value; its digits, letters and entropy are of all.
_LOOK = 100
# A run of key characters without a name is a candidate from this length on.
_KEY = 16
# Digits in a card number: its last one is a check digit.
_CARD_LENGTHS = range(13, 20)

# Word lists of the labelers.
_SECRET_NAMES = frozenset("token password passwd pwd secret apikey api_key key access_key auth credential passphrase pin private_key secret_key bearer".split())
_PLAIN_NAMES = frozenset("id size width height color colour version page count date time year http https note class style type name title lang source".split())
_KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xox", "AIza", "eyJ")
_NEAR_WORDS = frozenset("phone tel telephone mobile call fax mail email contact account iban card login user password secret token key auth".split())
_FAR_WORDS = frozenset("price order version isbn issn page volume serial model part article invoice ref".split())
_NUMBER_NEXT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ._-")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start; code points, end exclusive."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP(text):
        # Long parts are too large whatever their digits are, unless they are zeros.
        if all(int(p[-20:]) <= 255 and not p[:-20].strip("0") for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def added_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Further candidates (kind, start, end, name before it), by start, the longest first.

    They may overlap base spans and each other; whatever their length, each is judged as a whole.
    Those that lie in base spans are left out. A base span explains its own characters, so a run
    of key characters without a name needs its length beside them.
    """
    found: list[tuple[str, int, int, str]] = []
    run_start = run_end = 0  # assignments inside one run of value characters all end with it
    for m in _ASSIGNED(text):
        name = _NAME(text, max(0, m.start() - 28), m.start())
        if name:
            start = _OPENED(text, m.end()).end()
            if not run_start <= start < run_end:
                run_start, run_end = start, _VALUE(text, start).end()
            if run_end - start >= 6:
                found.append(("secret", start, run_end, name.group(1).lower()))
    end = 0
    for m in _DIGITS(text):  # numbers and keys have digits, and digits are rare: look around each
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if m.end() - m.start() >= 9 and before not in _NUMBER_NEXT and after not in _NUMBER_NEXT:
            found.append(("number", *m.span(), ""))
        if m.end() - m.start() == 3 and (phone := _LOCAL_PHONE(text, m.start() - (before == "("))):
            found.append(("local_phone", *phone.span(), ""))
        if m.start() >= end:
            start = m.start()
            while start > end and text[start - 1] in _KEY_CHARS:
                start -= 1
            end = _KEY_TAIL(text, m.end()).end()
            if end - start >= _KEY and m.end() - m.start() < end - start:
                found.append(("secret", start, end, ""))
    if _SPELLED_HINT(text):
        found += [("spelled_email", *m.span(), "") for m in _SPELLED(text)]
    covered = _coverage(base)
    return [
        c
        for c in sorted(set(found), key=lambda c: (c[1], -c[2], c[0]))
        if c[2] - c[1] - (covered(c[2]) - covered(c[1])) >= (_KEY if c[0] == "secret" and not c[3] else 1)
    ]


def _coverage(spans: list[tuple[str, int, int]]):
    """How many characters before a place lie in spans."""
    starts, ends, before = [], [], [0]
    for start, end in sorted((s, e) for _, s, e in spans):
        start = max(start, ends[-1]) if ends else start
        if start < end:
            starts.append(start)
            ends.append(end)
            before.append(before[-1] + end - start)

    def covered(place: int) -> int:
        k = bisect_left(starts, place)
        return before[k] - max(0, ends[k - 1] - place) if k else 0

    return covered


def measured(text: str, candidates: list[tuple[str, int, int, str]]) -> list[tuple[int, int, float]]:
    """Digits, letters and entropy of each candidate (by start); equal ends are counted once."""
    out, ends = [], {}
    for _, start, end, _ in reversed(candidates):
        before, digits, letters, counts, total = ends.get(end) or (end, 0, 0, Counter(), 0.0)
        part = text[start:before]
        for char, more in Counter(part).items():
            old = counts[char]
            new = counts[char] = old + more
            total += new * math.log2(new) - (old * math.log2(old) if old else 0.0)
        digits, letters = digits + sum(map(str.isdigit, part)), letters + sum(map(str.isalpha, part))
        ends[end] = start, digits, letters, counts, total
        out.append((digits, letters, max(0.0, math.log2(end - start) - total / (end - start)) + 1e-9))
    return out[::-1]


def judged(text: str, kind: str, start: int, end: int, name: str, measures: tuple[int, int, float] | None = None) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of the labelers (1, -1, 0) and features of a candidate."""
    value, length = text[start : min(end, start + _LOOK)], end - start
    digits, letters, entropy = measures or measured(text, [(kind, start, end, name)])[0]
    around = {w.strip(".,:;()").lower() for w in text[max(0, start - 40) : start].split()[-5:]}
    checked = 0
    if kind in ("card", "number") and digits in _CARD_LENGTHS:
        checked = 1 if luhn("".join(filter(str.isdigit, value))) else -1
    shape = {
        "secret": 1 if digits and letters and length >= 12 else -1,
        "number": 1 if checked > 0 or (not checked and 9 <= length <= 18 and len(set(value)) > 3) else -1,
        "local_phone": 1 if value[0] == "(" or value.count("-") == 2 else 0,
        "spelled_email": 1,
    }.get(kind, 1)
    listed = 1 if name in _SECRET_NAMES else -1 if name in _PLAIN_NAMES else 0
    prefix = 1 if value.startswith(_KEY_PREFIXES) else 0
    if kind == "email":
        prefix = 1 if text[start:end].rsplit(".", 1)[-1].isalpha() else -1
    near = 1 if around & _NEAR_WORDS else -1 if around & _FAR_WORDS else 0
    mixed = 1 if entropy >= 2.5 and kind != "number" else -1 if entropy < 1.5 or (kind == "secret" and not digits) else 0
    features = (
        KINDS.index(kind),
        min(length // 8, 5) + (length > _LOOK),
        int(entropy),
        0 if not digits else 1 if digits < letters else 2 if letters else 3,
        1 if name in _SECRET_NAMES else 2 if name else 0,
        prefix + 1,
        checked + 1,
    )
    return (shape, listed, prefix, near, mixed, checked), features


N_LABELERS = 6


@dataclass
class Model:
    """Combinations of features that are personal, with what was learnt on the way."""

    accepted: dict[tuple[int, ...], float] = field(default_factory=dict)
    reliability: np.ndarray = field(default_factory=lambda: np.zeros((N_LABELERS, 2, 3)))
    prior: float = 0.5


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation for labelers that are independent given the truth.

    ``votes`` (combination x labeler, in -1, 0, 1) with how often each occurs. Returns the
    probability of each combination, the labelers' vote tables [labeler, truth, vote + 1], and the
    prior. The start is the majority vote, which also fixes which truth is which.
    """
    weight = counts.astype(float)
    truth = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    tables, prior = np.full((votes.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        prior = float(np.clip((weight * truth).sum() / weight.sum(), 0.02, 0.98))
        for k in range(votes.shape[1]):
            for y in (0, 1):
                share = weight * (truth if y else 1 - truth)
                table = np.bincount(votes[:, k] + 1, share, 3) + 0.01 * weight.sum() / len(weight) + 0.1
                tables[k, y] = table / table.sum()
        log_odds = math.log(prior / (1 - prior)) + sum(np.log(tables[k, 1, votes[:, k] + 1] / tables[k, 0, votes[:, k] + 1]) for k in range(votes.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - truth).max() < 1e-7:
            break
        truth = new
    return truth, tables, prior


def _one_hot(features: list[tuple[int, ...]]) -> np.ndarray:
    width = (len(KINDS), 7, 8, 4, 3, 3, 3)
    out = np.zeros((len(features), sum(width) + 1))
    out[:, -1] = 1
    for i, f in enumerate(features):
        at = 0
        for value, w in zip(f, width, strict=True):
            out[i, at + min(value, w - 1)] = 1
            at += w
    return out


def train(combinations: list[tuple[tuple[int, ...], tuple[int, ...], int]]) -> Model:
    """Reliabilities, then the span classifier, from (votes, features, count)."""
    if not combinations:
        return Model()
    votes = np.array([c[0] for c in combinations])
    counts = np.array([c[2] for c in combinations])
    truth, tables, prior = estimate(votes, counts)
    x, weight = _one_hot([c[1] for c in combinations]), np.sqrt(counts)  # damped: kinds differ by far
    theta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (truth - p)) - theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(theta))
        theta += np.linalg.solve(hessian, gradient)
    p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
    accepted = {c[1]: float(q) for c, q in zip(combinations, p, strict=True) if q >= 0.5}
    return Model(accepted, tables, prior)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Learn from all texts. Null is the empty text; without candidates nothing is added later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                for b in base:
                    seen[judged(text, *b, "")] += 1
                found = added_candidates(text, base)
                for c, measures in zip(found, measured(text, found), strict=True):
                    seen[judged(text, *c, measures)] += 1
        votes, features = [list(v) for v, _ in seen], [list(f) for _, f in seen]
        small = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(votes, small), pa.array(features, small), pa.array(list(seen.values()), pa.int64())], ["votes", "features", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "votes array<int>, features array<int>, n long")
    rows = counted.groupBy("votes", "features").agg(F.sum("n").alias("n")).collect()
    return train(sorted((tuple(r.votes), tuple(r.features), r.n) for r in rows))


def added_spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    """Accepted candidates, the outermost first; what base spans cover of them is theirs."""
    found = added_candidates(text, base)
    taken = sorted((s, e) for _, s, e in base)
    out, last, k = [], 0, 0
    for c, measures in zip(found, measured(text, found), strict=True):
        if c[2] <= last or judged(text, *c, measures)[1] not in model.accepted:
            continue
        at, last = max(c[1], last), c[2]
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        while k < len(taken) and taken[k][0] < last:
            if taken[k][0] > at:
                out.append((c[0], at, taken[k][0]))
            at = max(at, taken[k][1])
            k += 1
        if at < last:
            out.append((c[0], at, last))
        last = max(last, at)
    return sorted(out)


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, counts of base kinds, ``base_sha256``, ``spans``, ``n_added``.

    ``spans`` lists kind:start:end (code points, end exclusive), base kinds first, then added
    ones by name. Null is the empty text; repeated rows give equal rows; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, n_added = {k: [] for k in BASE}, [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                added = added_spans(text, base, model)
                for kind in BASE:
                    counts[kind].append(sum(b[0] == kind for b in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(base + added))
                n_added.append(len(added))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(n_added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string", "n_added long"])
    return _texts(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spans replaced by their kinds in brackets; overlapping ones by the first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts = []
            for value in batch.column(place):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    text = redacted(text, base + added_spans(text, base, model))
                texts.append(text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
