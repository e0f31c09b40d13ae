"""Normalisation through a SentencePiece model's compiled character map, with source alignment.

The map is a double-array trie of UTF-8 prefixes whose values point into a pool of replacement
strings. At each place the longest prefix that the trie holds is replaced; where it holds none,
one character is copied. Each byte that comes out carries the bytes of the source it came from.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np


def _fields(data: bytes):
    """(number, value) of a protobuf message's top fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class NormalizerSpec:
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape: bool = True


def normalizer_spec(model: bytes) -> NormalizerSpec:
    """The normalizer's settings in a serialised model (field 3 of a model's message)."""
    found = dict(_fields(next((v for n, v in _fields(model) if n == 3), b"")))
    return NormalizerSpec(bytes(found.get(2, b"")), bool(found.get(3, 1)), bool(found.get(4, 1)), bool(found.get(5, 1)))


class CharsMap:
    """Longest-prefix replacement; an empty map copies every character."""

    def __init__(self, compiled: bytes):
        self.units, self.pool = [], b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.pool = compiled[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and what replaces it."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if not found:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


def _copied(data: bytes, spec: NormalizerSpec) -> tuple[bytes, np.ndarray]:
    """``normalise`` for an empty map, where no space goes: every character is its own longest prefix."""
    space = "▁".encode() if spec.escape else b" "
    spaces = np.frombuffer(data, np.uint8) == 32
    source = np.repeat(np.arange(len(data)), np.where(spaces, len(space), 1))
    before = len(space) if spec.dummy_prefix else 0
    return space[:before] + data.replace(b" ", space), np.concatenate([np.zeros(before, np.int64), source, [len(data)]])


def normalise(text: str, spec: NormalizerSpec, table: CharsMap | None = None) -> tuple[bytes, np.ndarray]:
    """The normalised text in UTF-8 and, for each of its bytes and for its end, the source's byte.

    Spaces are stripped, merged and escaped and the dummy prefix is put before the text as the
    settings say; an added byte points at the place where it was added, the bytes of a replacement at the
    begin of what they replace. An empty text stays empty. ``table`` is the map of spec, if it's at hand.
    """
    data, table = text.encode(), table or CharsMap(spec.charsmap)
    if data and not table.units and not spec.strip_spaces:
        return _copied(data, spec)
    parts: list[tuple[bytes, int, int]] = []  # what comes out, source's begin and end
    at = 0
    while at < len(data):
        if hit := table.longest(data, at):
            size, out = hit
        else:
            size = 1
            while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                size += 1
            out = data[at : at + size]
        parts.append((out, at, at + size))
        at += size
    if spec.strip_spaces:
        while parts and parts[0][0] == b" ":
            parts.pop(0)
        while parts and parts[-1][0] == b" ":
            parts.pop()
    if not parts:
        return b"", np.array([len(data)], np.int64)
    space = "▁".encode() if spec.escape else b" "
    out, source, last = bytearray(), [], False
    if spec.dummy_prefix:
        out += space
        source += [parts[0][1]] * len(space)
        last = spec.strip_spaces
    for piece, begin, end in parts:
        if last and spec.strip_spaces:
            piece = piece.lstrip(b" ")
        done = piece.replace(b" ", space)
        out += done
        source += range(begin, end) if done == data[begin:end] else [begin] * len(done)
        if piece:
            last = piece.endswith(b" ")
    if spec.strip_spaces:
        while out.endswith(space):
            del out[-len(space) :], source[-len(space) :]
    return bytes(out), np.array([*source, parts[-1][2]], np.int64)


def spans(pieces: list[bytes], aligned: np.ndarray) -> list[tuple[int, int]]:
    """Source spans of pieces that lie end to end in a normalised text with that alignment."""
    ends = np.cumsum([0, *map(len, pieces)])
    return [(int(aligned[a]), int(aligned[b])) for a, b in zip(ends, ends[1:])]
