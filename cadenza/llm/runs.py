"""Splitting of texts into runs that a tokenizer encodes independently of each other.

A cut is made before each single space that stands between two characters that are no white
space. No pre-token of a byte-level tokenizer and no piece of a space-escaping SentencePiece
model reaches over such a place, so the tokens of a text are those of its runs in order. Arrow
splits a slice of texts and numbers its distinct runs; a worker encodes those that it hasn't met,
many at once, and deals the tokens back by their lengths in bytes; numpy puts the texts' tokens
together from the runs' numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: U+2581 is the escaped space of SentencePiece.
_CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
#: ``odd`` for RE2.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
_ODD = f"^$|^{_SPACE}|{_SPACE}$|▁"
#: Texts are handled in slices of about so many bytes, so that few runs are in memory.
SLICE_BYTES = 4_000_000
#: Runs that a worker keeps, of so many characters at the most.
MOST, LONGEST = 800_000, 64


def odd(run: str) -> bool:
    """Whether a run between spaces may depend on its neighbours: such texts are cut with more care."""
    return not run or run.strip() != run or "▁" in run


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """texts in slices of about ``size`` bytes, of one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield texts.slice(at, to - at)
        at = to


class RunTable:
    """Tokens, or numbers of tokens, of runs, by slices of texts.

    ``encode(runs, spaced)`` gives the tokens of many runs, end to end, and where those of each end;
    ``each`` gives the same for runs that must not be encoded as one text. ``hot`` has the numbers of tokens
    of frequent spaced runs: a fixed first tier, for counts alone. Other runs are kept, about ``most`` of them;
    when the table is full it's emptied, so a worker's memory stays bounded. ``dtype`` is None for counts.
    """

    def __init__(self, encode: Callable, each: Callable, dtype: np.dtype | None = None, hot: dict[str, int] | None = None, most: int = MOST):
        self.encode, self.each, self.dtype, self.hot, self.most = encode, each, dtype, hot or {}, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = dict(zip(self.hot, range(len(self.hot))))  # of spaced runs
        self.size = np.fromiter(self.hot.values(), np.int64, len(self.hot))
        self.begin = np.zeros(len(self.hot), np.int64)
        self.flat = np.zeros(0, self.dtype or np.int64)

    def _add(self, found: tuple[np.ndarray, list[int]]) -> int:
        """Puts runs' tokens into the table; returns the first one's place."""
        ids, ends = found
        ends = np.asarray(ends, np.int64)
        at, first = len(self.flat), len(self.size)
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.size = np.concatenate([self.size, ends - begin])
        if self.dtype is not None:
            self.begin = np.concatenate([self.begin, begin + at])
            self.flat = np.concatenate([self.flat, ids.astype(self.dtype)])
        return first

    def _places(self, runs: list[str]) -> np.ndarray:
        """Places of spaced runs, each given once, none of them odd."""
        found = np.fromiter(map(self.place.get, runs, repeat(-1)), np.int64, len(runs))
        new = np.flatnonzero(found < 0)
        if len(new):
            unmet = [runs[k] for k in new.tolist()]
            found[new] = self._add(self.encode(unmet, True)) + np.arange(len(new))
            self.place.update((run, at) for run, at in zip(unmet, found[new].tolist()) if len(run) <= LONGEST)
        return found

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of all runs of the texts in order their places; how many runs each text has (an empty one: none)."""
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy()[:-1]
        coded = lists.flatten().dictionary_encode()
        runs, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.size) + len(runs) > self.most or len(self.flat) > 8 * self.most:
            self._clear()
        strange = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)
        apart = np.logical_or.reduceat(strange[number], starts)
        inner = np.ones(len(number), bool)
        inner[starts] = False  # a text's first run has no space before it
        count = np.diff(np.append(starts, len(number)))
        inner &= ~np.repeat(apart, count)
        used = np.zeros(len(runs), bool)
        used[number[inner]] = True
        where = np.zeros(len(runs), np.int64)
        known = np.flatnonzero(used)
        where[known] = self._places([runs[k] for k in known.tolist()])
        place = where[number]
        # First runs, a few for each slice, are encoded as they stand and aren't kept.
        heads = np.unique(number[starts[~apart]])
        here = np.zeros(len(runs), np.int64)
        base = len(self.size)
        self._add(self.each([runs[k] for k in heads.tolist()], False))
        here[heads] = base + np.arange(len(heads))
        place[starts] = here[number[starts]]
        if apart.any():
            place, count = self._with_odd(texts, place, count, np.flatnonzero(apart))
        return place, count

    def _with_odd(self, texts: pa.Array, place: np.ndarray, count: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_slice``, with texts of odd runs cut by _CUT; what's odd then is encoded by itself and not kept."""
        split = [_CUT.split(t) if t else [] for t in texts.take(pa.array(which)).to_pylist()]
        seen = dict.fromkeys(run for runs in split for run in runs[1:])
        plain = [run for run in seen if not odd(run)]
        at = dict(zip(plain, self._places(plain).tolist()))
        strange = [run for run in seen if run not in at]
        first = self._add(self.each(strange, True))
        at.update(zip(strange, range(first, first + len(strange))))
        heads = list(dict.fromkeys(runs[0] for runs in split if runs))
        first = self._add(self.each(heads, False))
        head = dict(zip(heads, range(first, first + len(heads))))
        found = [np.array([head[runs[0]], *map(at.__getitem__, runs[1:])], np.int64) if runs else np.zeros(0, np.int64) for runs in split]
        parts = np.split(place, np.cumsum(count)[:-1])
        count = count.copy()
        for k, own in zip(which.tolist(), found):
            parts[k], count[k] = own, len(own)
        return np.concatenate(parts), count

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; a null is an empty text."""
        out = [np.zeros(0, np.int64)]
        for one in slices(texts.fill_null("")):
            place, count = self._slice(one)
            sums = np.concatenate([[0], np.cumsum(self.size[place])])
            ends = np.cumsum(count)
            out.append(sums[ends] - sums[ends - count])
        return np.concatenate(out)

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The tokens of each text; a null is an empty text."""
        for one in slices(texts.fill_null("")):
            place, count = self._slice(one)
            size = self.size[place]
            ends = np.cumsum(size)
            flat = self.flat[np.repeat(self.begin[place] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], count]))].tolist()
            yield from (flat[a:b] for a, b in zip(bounds, bounds[1:]))


def dealt(ids: np.ndarray, width: np.ndarray, runs: list[str]) -> np.ndarray | None:
    """Where the tokens of each run end, if ids encode the runs with a space before each.

    None if the lengths of the tokens in bytes don't meet the ends of the runs.
    """
    ends = np.cumsum(pc.binary_length(pa.array(runs, pa.string())).to_numpy() + np.int64(1))
    reach = np.cumsum(width[ids])
    at = np.searchsorted(reach, ends)
    return at + 1 if len(reach) and at[-1] == len(reach) - 1 and (reach[at] == ends).all() else None


def cuts_at_spaces(tokenizer_json: str) -> bool:
    """Whether runs of a .json tokenizer are independent: byte-level pre-tokens, no normalizer."""
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    plain = not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
    bare = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return spec.get("normalizer") is None and bare and plain
