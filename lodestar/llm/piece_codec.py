"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (field numbers are the format's own), and a tokenizers model is rebuilt
from it: the normaliser, the space marker, unigram scores or, for a BPE model, the merges that its scores
order, and byte fallback.  Words (each with the spaces before it) are encoded independently of each other,
because no piece has a space marker after another character; where a model has such pieces, or a text holds
the marker itself, whole texts are encoded.  A worker encodes each distinct word once, in multithreaded batches of joined
words: most of the time of a call goes to the call, not to the word.  Every text is also encoded as a whole by the
SentencePiece library: it has parity if all its ids are the same.

Defined cases: null text is empty and has no ids (parity holds, and it is restored as empty); texts of any length are
encoded as a whole; ids outside the vocabulary decode to nothing; control pieces decode to nothing; user-defined pieces
are encoded as ordinary ones, and parity tells where that differs; repeated rows give repeated results; an empty table
gives an empty result; :func:`decode` carries all columns and names its own so that it clashes with none of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import PieceCache, kept_alone, ragged
from ._scratch import fresh
from ._text import Texts, chunks

MARKER = "▁"
# Piece kinds and model kinds of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Words that are joined to one text for the tokenizers library.
_JOINED = 32


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) pairs of a protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    drop_blanks: bool = True
    mark_blanks: bool = True

    @classmethod
    def load(cls, path: str) -> PieceModel:
        out = cls()
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    out.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
                elif number == 2:
                    trainer = dict(_fields(value))
                    out.kind, out.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
                elif number == 3:
                    spec = dict(_fields(value))
                    out.charsmap = spec.get(2, b"")
                    out.add_prefix, out.drop_blanks, out.mark_blanks = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        return out

    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def by_words(self) -> bool:
        """Whether texts may be cut before every run of spaces."""
        inner = any(MARKER in p.lstrip(MARKER) for p, _, kind in self.pieces if kind in (NORMAL, USER))
        return not (inner or self.charsmap or self.drop_blanks or self.kind != BPE)


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, in the order in which the scores let them merge."""
    place = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for p, i in place.items():
        cuts = [(place[p[:k]], place[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in place and p[k:] in place]
        found += [(-pieces[i][1], i, *cut) for cut in sorted(cuts)]
    return [(a, b) for *_, a, b in sorted(found, key=lambda m: m[:4])]


def rebuilt(model: PieceModel):
    """A tokenizers tokenizer of the model, for normalised text with markers."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == BPE:
        core = models.BPE(vocab=vocab, merges=merges(model.pieces), unk_token=model.pieces[model.unknown()][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown(), byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.drop_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARKER))
    out.normalizer = normalizers.Sequence(steps)
    return out


class Codec:
    """Encodes and decodes chunks of texts; one per worker process."""

    def __init__(self, path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = PieceModel.load(path)
        self.whole = rebuilt(self.model)
        self.checker = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words = self.model.by_words()
        self.plain = Tokenizer(self.whole.model)  # for words, whose spaces are markers already
        ordinary = [p if kind in (NORMAL, USER) else "" for p, _, kind in self.model.pieces]
        self.head = np.array([p.startswith(MARKER) for p in ordinary])
        self.blank = np.array([p != "" and not p.strip(MARKER) for p in ordinary])
        self.joins = MARKER in ordinary
        self.cache = PieceCache(self._encode)
        self.spell = [self._bytes(p, kind) for p, _, kind in self.model.pieces]
        self.spelt = pa.array(self.spell, pa.large_binary())

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind in (CONTROL, UNUSED):
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARKER, " ").encode()

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.  Joined words (spaces, then anything else) are told apart by their ids: no piece crosses their
        borders, and each begins with the only piece that has a marker in front and no piece of markers alone before it."""
        fit = [self.joins and w[0] == 0x20 != w[-1] for w in words]
        several, alone = list(compress(words, fit)), [w for w, f in zip(words, fit, strict=True) if not f]
        groups = [b"".join(several[at : at + _JOINED]) for at in range(0, len(several), _JOINED)]
        texts = [w.decode().replace(" ", MARKER) for w in groups + alone]
        found = [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        flat = list(chain.from_iterable(found[: len(groups)]))
        ids = np.array(flat, np.int32)
        new = self.head[ids]
        new[1:] &= ~self.blank[ids[:-1]]
        cuts = [*np.flatnonzero(new).tolist(), len(flat)]
        if len(cuts) - 1 != len(several):
            raise ValueError("joined words can't be told apart")
        joined, single = (flat[a:b] for a, b in pairwise(cuts)), iter(found[len(groups) :])
        return [next(joined if f else single) for f in fit]

    def __call__(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, where each text's begin (one more at the end), and its parity."""
        raw = part.data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(part.offsets.tolist(), part.offsets[1:].tolist(), strict=False)]
        ids, begins = self._whole(texts) if not self.words or MARKER.encode() in raw else self._by_words(part)
        return ids, begins, self._parity(texts, ids, begins)

    def _by_words(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = part.data, part.offsets
        if self.model.add_prefix:  # a space before every text that is not empty
            size = np.diff(offsets)
            data = np.insert(data, offsets[:-1][size > 0], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(size > 0)])
        space = data == 0x20
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = space[1:] & ~space[:-1]
        start[offsets[:-1]] = True
        begin = np.flatnonzero(start[:-1])
        found, n = self.cache.lookup(data, begin, np.append(begin[1:], len(data)))
        return found, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, offsets)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids if t else [] for e, t in zip(self.whole.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)])

    def _parity(self, texts: list[str], ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether each text's ids are those that the SentencePiece library gives it."""
        found = self.checker.encode(texts, num_threads=1, return_type="numpy")
        theirs = np.concatenate([np.zeros(0, np.int32), *found])
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        n = np.diff(begins)
        out = n == np.diff(at)
        place = np.concatenate([[0], np.cumsum(np.where(out, n, 0))])
        differs = ids[ragged(begins[:-1][out], n[out])] != theirs[ragged(at[:-1][out], n[out])]
        wrong = np.concatenate([[0], np.cumsum(differs)])[place] if out.any() else np.zeros(len(place), np.int64)
        return out & (np.diff(wrong) == 0)

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after the other, and where each text's begin; the prefixed space is taken off."""
        ids = np.where((ids >= 0) & (ids < len(self.spell)), ids, 0 if not self.spell[0] else self._empty())
        _, ends, letters = self.spelt.take(pa.array(ids)).buffers()
        ends = np.frombuffer(ends, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = np.frombuffer(letters, np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
        at = ends[begins]
        if not self.model.add_prefix:
            return data, at
        first = at[:-1][(np.diff(at) > 0)]
        first = first[data[first] == 0x20]
        cut = np.zeros(len(data) + 1, np.int64)
        cut[first + 1] = 1
        return np.delete(data, first), at - np.cumsum(cut)[at]

    def _empty(self) -> int:
        return next((i for i, s in enumerate(self.spell) if not s), 0)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after the other, and where each list begins (one more at the end)."""
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int32, int(begins[-1])), begins


@kept_alone
def codec(path: str) -> Codec:
    """The worker's codec for a model; it stays between tasks."""
    return Codec(path)


def _lists(ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, parity of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in chunks(batch.column(1)):
                ids, begins, parity = own(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), _lists(ids, begins), pa.array(parity)], ["doc_id", "ids", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, parity boolean")


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns, and ``decoded`` (or a like name that is free): the text of the ids (null ids: null)."""
    name = fresh(coded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(part.schema.get_field_index(ids))
                n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
                data, begins = own.decode(flat, np.concatenate([[0], np.cumsum(n)]))
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begins, begins[1:], strict=False)]
                texts = pa.array(texts, pa.string(), mask=np.asarray(column.is_null()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{kinds}, {name} string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids, parity, and whether decoding the ids gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in chunks(batch.column(1)):
                ids, begins, parity = own(part)
                data, at = own.decode(ids, begins)
                same = [a1 - a0 == b1 - b0 and np.array_equal(data[a0:a1], part.data[b0:b1]) for a0, a1, b0, b1 in zip(at, at[1:], part.offsets, part.offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(np.diff(begins)), _lists(ids, begins), pa.array(parity), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "parity", "restored"])

    coded = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, parity boolean, restored boolean")
    return coded.select("doc_id", "n_ids", F.col("ids"), "parity", "restored")
