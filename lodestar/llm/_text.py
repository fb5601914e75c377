"""Texts of an Arrow batch as byte arrays, cut into words and hashed without a Python loop per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time; a single longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Spans of more bytes are hashed by BLAKE2, one by one; shorter ones side by side, eight bytes at a time.
LONG = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The lowest n bytes of a number, for n from 0 to 8.
_LOWEST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by sorting (several times as fast as hashing them)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

@dataclass
class Texts:
    """Rows ``first`` to ``first + len(offsets) - 2`` of a batch; text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """A string column (null: empty) as chunks of about ``limit`` bytes that do not split a text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n, at + 4000)
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; no run crosses a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | border[1:n]
    end[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Spans:
    """Any spans of one byte array, read eight bytes at a time: their 64-bit hashes, and whether they equal others.

    Equal bytes have equal hashes.  Different bytes may not: whoever needs certainty compares the bytes.
    """

    def __init__(self, data: np.ndarray):
        self.padded = np.zeros(len(data) + 8, np.uint8)
        self.padded[: len(data)] = data
        self.data = self.padded[: len(data)]
        self.lanes = np.ndarray((len(data) + 1,), "<u8", self.padded, strides=(1,))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(np.uint64) * _ODD + np.uint64(1))
        at = np.flatnonzero(size <= LONG)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        begin, rest = start[at], size[at]
        while len(at):
            lane = self.lanes[begin] & _LOWEST[np.minimum(rest, 8)]
            out[at] = mix((out[at] ^ lane) * _ODD)
            on = np.flatnonzero(rest > 8)
            at, begin, rest = at[on], begin[on] + 8, rest[on] - 8
        return out

    def equal(self, start: np.ndarray, end: np.ndarray, other: Spans, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether span i here has the bytes of span i there."""
        size = end - start
        out = size == stop - begin
        for i in np.flatnonzero(out & (size > LONG)).tolist():
            out[i] = np.array_equal(self.data[start[i] : end[i]], other.data[begin[i] : stop[i]])
        at = np.flatnonzero(out & (size <= LONG))
        mine, theirs, rest = start[at], begin[at], size[at]
        while len(at):
            mask = _LOWEST[np.minimum(rest, 8)]
            same = (self.lanes[mine] ^ other.lanes[theirs]) & mask == 0
            out[at[~same]] = False
            on = np.flatnonzero(same & (rest > 8))
            at, mine, theirs, rest = at[on], mine[on] + 8, theirs[on] + 8, rest[on] - 8
        return out


def shingles(hashes: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the text of each; a shorter text is one shingle of all its words."""
    counts = np.diff(begins)
    n = np.where(counts >= width, counts - width + 1, counts > 0)
    text = np.repeat(np.arange(len(counts)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begins[:-1][text]
    long = (counts >= width)[text]
    out = np.full(len(first), 0x51ED270B2F6D, np.uint64)
    end = begins[1:][text]
    for k in range(width):
        at = first + k
        have = at < end
        step = hashes[np.where(have, at, 0)] if len(hashes) else np.zeros(len(at), np.uint64)
        out = np.where(have & (long | (k < counts[text])), mix(out * np.uint64(3) + step), out)
    return out, text


def sequence_keys(hashes: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each text's sequence of words."""
    raw = hashes.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False)]
