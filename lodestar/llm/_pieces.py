"""What is computed once for each distinct piece of text, such as its token ids, and looked up for all its places.

Pre-tokenisation cuts a text into pieces that are encoded independently of each other, so a worker encodes
each distinct piece once, keeps its ids, and puts the ids of a text together with array operations.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from functools import wraps
from itertools import chain

import numpy as np

from ._text import LOWER, SPACE, Spans, Texts, mix, runs

#: The tokenizers library's threads in a worker, unless its environment says otherwise: a task has one core, and every
#: thread has its own memory arena.
os.environ.setdefault("RAYON_NUM_THREADS", "2")

#: Bytes of distinct pieces that a cache holds before it is emptied.
HELD_BYTES = 16 << 20


_KEPT: list[dict] = []


def kept_alone(build: Callable) -> Callable:
    """What a worker builds once and keeps between tasks; building another such thing lets this go, as the stages that
    use them follow one another."""
    held: dict = {}
    _KEPT.append(held)

    @wraps(build)
    def get(*args):
        if args not in held:
            for other in _KEPT:
                other.clear()
            held[args] = build(*args)
        return held[args]

    return get


class PieceCache:
    """Numbers of pieces by their bytes; emptied when it holds ``limit`` pieces, so that memory is bounded.

    The hash table is a pair of arrays with linear probing, looked up for all pieces of a chunk at once.  Every hit is
    compared with the bytes it stands for; pieces whose hashes collide go on to a further hash each.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = 500_000, kind=np.int32):
        self.encode, self.limit, self.kind = encode, limit, kind
        self.mask = np.uint64((1 << (2 * limit).bit_length()) - 1)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)  # 0: a free slot
        self.entry = np.zeros(int(self.mask) + 1, np.int32)
        self.ids = np.zeros(1 << 16, self.kind)
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.letter = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.spelt = Spans(np.zeros(1 << 20, np.uint8))  # the pieces' bytes, one after the other
        self.known = self.used = self.written = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        slot = (hashes & self.mask).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == hashes, self.entry[slot], -1)
        left = np.flatnonzero((there != hashes) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & int(self.mask)
            there = self.keys[slot]
            hit = there == hashes[left]
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return out

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        found = self.encode(pieces)
        n = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.array(list(chain.from_iterable(found)), self.kind)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        k = self.known
        while k + len(n) > len(self.begin):
            for name in ("begin", "count", "letter", "size"):
                setattr(self, name, np.concatenate([getattr(self, name)] * 2))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids] * 2)
        total = int(size.sum())
        if self.written + total > len(self.spelt.data):
            data = np.zeros(max(2 * len(self.spelt.data), self.written + total), np.uint8)
            data[: self.written] = self.spelt.padded[: self.written]
            self.spelt = Spans(data)
        self.spelt.padded[self.written : self.written + total] = np.frombuffer(b"".join(pieces), np.uint8)
        self.ids[self.used : self.used + len(flat)] = flat
        at = slice(k, k + len(n))
        self.begin[at] = np.cumsum(n) - n + self.used
        self.count[at] = n
        self.letter[at] = np.cumsum(size) - size + self.written
        self.size[at] = size
        self.used += len(flat)
        self.written += total
        self.known += len(n)
        left, slot = np.arange(len(n)), (hashes & self.mask).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            placed = self.keys[slot] == hashes[left]
            self.entry[slot[placed]] = k + left[placed]
            left, slot = left[~placed], (slot[~placed] + 1) & int(self.mask)

    def lookup(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces data[begin[i]:end[i]] one after the other, and how many each piece has."""
        if self.known > self.limit or self.written > HELD_BYTES:
            self._clear()
        text = Spans(data)
        hashes = np.maximum(self.hashed(text, begin, end), np.uint64(1))
        at = self._find(hashes)
        left = np.arange(len(at))
        while len(left):
            missing = left[at[left] < 0]
            if len(missing):
                new, first = np.unique(hashes[missing], return_index=True)
                if self.known + len(new) > 1.3 * self.limit:  # one chunk that nearly fills the table
                    self._clear()
                    if len(begin) > self.limit:
                        half = len(begin) // 2
                        halves = self.lookup(data, begin[:half], end[:half]), self.lookup(data, begin[half:], end[half:])
                        return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
                    return self.lookup(data, begin, end)
                first = missing[first]
                self._add(new, [data[begin[i] : end[i]].tobytes() for i in first.tolist()])
                at[missing] = self._find(hashes[missing])
            own = at[left]
            same = text.equal(begin[left], end[left], self.spelt, self.letter[own], self.letter[own] + self.size[own])
            left = left[~same]
            hashes[left] = np.maximum(mix(hashes[left] + np.uint64(1)), np.uint64(1))
            at[left] = self._find(hashes[left])
        n = self.count[at].astype(np.int64)
        return self.ids[ragged(self.begin[at], n)], n

    @staticmethod
    def hashed(text: Spans, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return text.hashes(begin, end)


@kept_alone
def digests() -> PieceCache:
    """The worker's 64-bit BLAKE2 digests of words."""
    return PieceCache(lambda words: [(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"),) for w in words], 200_000, np.uint64)


def words(texts: Texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words (runs without ASCII white space), and where each text's words begin (one more at the end).

    A digest is BLAKE2's, of 64 bits: different words have different digests but for chance.
    """
    data = LOWER[texts.data] if lower else texts.data
    start, end = runs(~SPACE[data], texts.offsets)
    return digests().lookup(data, start, end)[0], np.searchsorted(start, texts.offsets)


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions begin[0], begin[0] + 1, ... (n[0] of them), begin[1], ..."""
    out = np.ones(int(n.sum()), np.int64)
    use = np.flatnonzero(n)
    if not len(use):
        return out
    b, k = begin[use], n[use]
    out[0] = b[0]
    out[np.cumsum(k)[:-1]] = b[1:] - b[:-1] - k[:-1] + 1
    return np.cumsum(out)
