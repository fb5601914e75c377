"""Byte-level BPE ids of whole texts, with the pre-tokenisation done by array operations.

The vocabulary is a tokenizers JSON file.  Each distinct piece is encoded once, by the tokenizers library; texts with
special tokens in them, and vocabularies with another pre-tokeniser or a normaliser, go to the library as a whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from ._pieces import PieceCache, kept_alone
from ._text import Texts

OTHER, LETTER, NUMBER, BLANK = range(4)
#: Pieces that the library encodes at a time.
_BATCH = 4096
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The endings that the pre-tokeniser's pattern takes together with an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[list(WHITE_SPACE)] = BLANK
    return table


def piece_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where pieces begin in a sequence of code points; ``borders`` are the texts' begins and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    border = np.zeros(n + 1, bool)
    border[borders] = True
    new = border[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(new)
    flag = new.copy()
    after = begins[(kind[begins] != BLANK) & ~border[begins] & (kind[np.maximum(begins - 1, 0)] == BLANK)]
    flag[after - 1] = True  # the last blank before a run is a piece, or begins the run's piece if it is a space
    flag[after[points[after - 1] == 0x20]] = False
    quote = begins[(points[begins] == 0x27) & flag[begins]]
    quote = quote[quote + 1 < n]
    quote = quote[new[quote + 1] & (kind[quote + 1] == LETTER) & ~border[quote + 1]]
    for p in quote.tolist():
        run = "".join(map(chr, points[p + 1 : p + 3]))
        for ending in ENDINGS:
            stop = p + 1 + len(ending)
            if run.startswith(ending) and not (len(ending) == 2 and new[p + 2]):
                flag[p + 1] = False
                if stop < n:
                    flag[stop] = True
                break
    return np.flatnonzero(flag)


class Encoder:
    """Encodes chunks of texts; one per worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = json.load(open(path, encoding="utf-8"))
        vocab = model["model"]["vocab"]
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        self.small = max(vocab.values()) < 1 << 16
        split = model["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model["normalizer"]:
            self.cache = None
        else:
            self.cache = PieceCache(self._library)

    def _library(self, pieces: list[bytes]) -> list[list[int]]:
        out = []
        for at in range(0, len(pieces), _BATCH):
            out += [e.ids for e in self.whole.encode_batch_fast([p.decode() for p in pieces[at : at + _BATCH]], add_special_tokens=False)]
        return out

    def __call__(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin (one more at the end)."""
        raw = part.data.tobytes()
        if self.cache is None or any(s.encode() in raw for s in self.special):
            return self._direct(part)
        lead = np.flatnonzero((part.data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, np.searchsorted(lead, part.offsets))
        begin = lead[starts]
        end = np.append(begin[1:], len(raw))
        ids, n = self.cache.lookup(part.data, begin, end)
        sums = np.concatenate([[0], np.cumsum(n)])
        return ids, sums[np.searchsorted(begin, part.offsets)]

    def _direct(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        texts = [part.data[a:b].tobytes().decode() for a, b in zip(part.offsets, part.offsets[1:], strict=False)]
        found = [np.array(e.ids, np.int32) for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)


@kept_alone
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary; it stays between tasks."""
    return Encoder(path)
