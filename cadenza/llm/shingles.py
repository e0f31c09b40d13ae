"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

Words are runs of bytes other than space, \\t, \\n, \\v, \\f, \\r, with A-Z lower-cased. A text's set is
its distinct shingles of k words; a text of fewer words (but not none) has one shingle, its whole
sequence. Two shingles are taken as equal if their hashes are: among the n shingles of a pair of
documents the odds of a wrong match are n * n / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_PLACE = np.array([pow(0xD6E8FEB86659FD93, 2 * i + 3, 1 << 64) for i in range(64)], np.uint64)
#: Texts are hashed in slices of about so many bytes.
SLICE = 500_000
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(b))]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of consecutive texts; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and where those of each text begin (one place more than texts)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    word = ~_SPACE[low]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edge] |= word[edge]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edge - 1] |= word[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = _mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX[0])
    return h, np.searchsorted(starts, offsets)


def occurrences(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, repeated ones too, and where those of each text begin."""
    counts = np.diff(first)
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += words[j : j + n] * _PLACE[j]
    rolled = _mixed(rolled)
    long = counts >= k
    out = np.zeros(bounds[-1], np.uint64)
    if long.any():
        lens = many[long]
        source = np.repeat(first[:-1][long] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        target = np.repeat(bounds[:-1][long] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        out[target] = rolled[source]
    for i in np.flatnonzero(~long & (counts > 0)):
        w = words[first[i] : first[i + 1]]
        out[bounds[i]] = _mixed((w * _PLACE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.array([len(w)], np.uint64) * _MIX[1])[0]
    return out, bounds


def sets(texts: pa.Array, k: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingles) of each text; of those marked in ``wanted`` only, if given."""
    for at, data, offsets in slices(texts):
        if wanted is not None and not wanted[at : at + len(offsets) - 1].any():
            continue
        found, bounds = occurrences(*word_hashes(data, offsets), k)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if wanted is None or wanted[at + i]:
                one = np.sort(found[a:b])
                yield at + i, one[np.concatenate([[True], one[1:] != one[:-1]])] if len(one) else one
