"""Words and shingles of whole batches of texts as 64-bit hashes, without a loop over words.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Null is the empty
text. Hashes are the same on every machine and in every batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but letters and digits, for tokens without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U64)
_TAIL = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, lower-cased, with eight zero bytes behind, and each text's borders in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=out[: len(data)])
    return out, offsets - offsets[0]


def word_spans(data: np.ndarray, borders: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text how many words lie before it (n + 1 values).

    ``between`` says which bytes separate words.
    """
    n = len(data) - 8
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    inside = ~between[data[:n]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = borders[(borders > 0) & (borders < n)]  # a word never goes on in the next text
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, borders)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = ends - starts
    eights = np.lib.stride_tricks.as_strided(data[:8].view(U64), shape=(max(len(data) - 7, 0),), strides=(1,))
    h = length.astype(U64) * _ODD[0]
    at, left, which = starts, length, slice(None)
    while len(at):
        piece = eights[at] & _TAIL[np.minimum(left, 8)]
        h[which] = mix(h[which] ^ piece)
        more = np.flatnonzero(left > 8)
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct sorted shingle hashes of each text.

    ``counts`` has the number of words before each text. A text of fewer than ``k`` words has its
    whole sequence as one shingle, one without words has none.
    """
    odd = np.resize(_ODD, k)
    n = len(words) - k + 1
    rolled = np.zeros(max(n, 0), U64)
    for j in range(k):
        if n > 0:
            rolled += (words[j : j + n] ^ (words[j : j + n] >> U64(7 + j))) * (odd[j] + U64(2 * j))
    rolled = mix(rolled) if n > 0 else rolled
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            parts = mix(words[a:b] * odd[: b - a] + U64(b - a))
            out.append(mix(np.bitwise_xor.reduce(parts, keepdims=True) ^ U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = 1 << 20):
    """Parts of a batch with about ``limit`` bytes of text: numpy's copies stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def text_shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    data, borders = buffers(texts)
    starts, ends, counts = word_spans(data, borders)
    return shingles(word_hashes(data, starts, ends), counts, k)
