"""Static binary-fuse filters: three-wise, 8-bit fingerprints, about nine bits a key, built in vectorised rounds."""

from __future__ import annotations

import struct

import numpy as np

from ._text import mix

_HEAD = struct.Struct("<QQQQ")  # seed, segment length, segments, keys


def _places(hashed: np.ndarray, length: int, segments: int) -> list[np.ndarray]:
    """Three slots a key: one in each of three neighbouring segments, the first segment drawn by the high bits."""
    first = ((hashed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    inner = np.uint64(length - 1)
    begin = first * np.uint64(length)
    offset = (hashed & inner, (hashed >> np.uint64(18)) & inner, mix(hashed) & inner)
    return [(begin + np.uint64(i * length) + o).astype(np.int64) for i, o in enumerate(offset)]


def _prints(hashed: np.ndarray) -> np.ndarray:
    return (mix(hashed ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter over 64-bit keys (repeated keys count once); an empty set gives a filter that holds nothing."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return _HEAD.pack(0, 1, 1, 0)
    length = 1 << max(2, min(17, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for attempt in range(1, 200):
        segments = max(1, int(np.ceil(n * (factor + 0.02 * (attempt // 5)) / length)))
        seed = int(mix(np.array([attempt], np.uint64))[0])
        hashed = mix(keys ^ np.uint64(seed))
        order = _peel(_places(hashed, length, segments), n, (segments + 2) * length)
        if order is not None:
            table = np.zeros((segments + 2) * length, np.uint8)
            prints, places = _prints(hashed), np.stack(_places(hashed, length, segments))
            for key, slot in reversed(order):
                table[slot] = 0
                table[slot] = prints[key] ^ table[places[0][key]] ^ table[places[1][key]] ^ table[places[2][key]]
            return _HEAD.pack(seed, length, segments, n) + table.tobytes()
    raise RuntimeError("no seed gives a filter")


def _peel(places: list[np.ndarray], n: int, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that each has alone); None if some keys are left over."""
    count = sum(np.bincount(p, minlength=slots) for p in places)
    ids = np.arange(n, dtype=np.float64)
    total = sum(np.bincount(p, weights=ids, minlength=slots) for p in places)
    stacked, order, left = np.stack(places), [], n
    ready = np.flatnonzero(count == 1)
    while len(ready):
        ready = ready[count[ready] == 1]
        key, at = np.unique(total[ready].astype(np.int64), return_index=True)
        if not len(key):
            break
        order.append((key, ready[at]))
        left -= len(key)
        touched = stacked[:, key]
        np.subtract.at(count, touched.ravel(), 1)
        np.subtract.at(total, touched.ravel(), np.tile(key.astype(np.float64), 3))
        ready = np.unique(touched[count[touched] == 1])
    return order if not left else None


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: always true for its own keys, true for others at a rate of 1 in 256."""
    seed, length, segments, n = _HEAD.unpack_from(blob)
    keys = np.asarray(keys, np.uint64)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    hashed = mix(keys ^ np.uint64(seed))
    a, b, c = (table[p] for p in _places(hashed, length, segments))
    return (a ^ b ^ c) == _prints(hashed)
