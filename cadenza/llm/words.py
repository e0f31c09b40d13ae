"""Words of many texts at once, numbered by Arrow, in numpy.

Bytes are told apart by a table of 256 kinds: WORD bytes make up words, GAP bytes stand between words,
BREAK bytes end a piece as well, so that no phrase reaches over them. A-Z are lower-cased. As only ASCII
bytes are gaps or breaks, words are whole characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import _LOWER, _mixed, _power

WORD, GAP, BREAK = 0, 1, 2
#: Texts are handled in slices of about so many bytes, of one text at least.
SLICE = 4_000_000


class Words:
    """The words of a slice of texts: the distinct ones, and each word's number, text and piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray):
        low = _LOWER[data]
        kind = kinds[low]
        word = kind == WORD
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        begin[edge] |= word[edge]
        end[:-1] &= ~word[1:]
        end[edge - 1] |= word[edge - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = np.ascontiguousarray(low[word])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
        self.distinct: pa.LargeBinaryArray = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.first = np.searchsorted(starts, offsets)  # how many words stand before each text
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        breaks = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
        #: whether a word and the next one are in one piece of one text
        self.joined = (breaks[1:] == breaks[:-1]) & (self.text[1:] == self.text[:-1])

    def names(self) -> pa.Array:
        return self.distinct.cast(pa.large_string())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        n = len(self.distinct)
        bounds = np.frombuffer(self.distinct.buffers()[1], np.int64)[: n + 1]
        data = np.frombuffer(self.distinct.buffers()[2] or b"", np.uint8)[: bounds[-1] if n else 0]
        power, inverse = _power(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        a, b = bounds[:-1], bounds[1:]
        return _mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def slices(texts: pa.Array, kinds: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) of consecutive texts; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], kinds)
        at = to


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order of their first places, and each key's number among them."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
