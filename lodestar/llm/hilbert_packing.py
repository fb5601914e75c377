"""Token sequences packed along a space-filling curve.

Each document's ids are hashed into a vector, the vector is projected to a few dimensions, and its place on
the Hilbert curve through them is its key.  Documents are range-partitioned and sorted by key, and every
partition cuts the stream of its documents' ids into sequences of ``LENGTH`` ids, so that neighbours on the
curve share sequences.  What is left at a partition's end becomes sequences whose lengths are powers of two:
no sequence needs padding.  Sequences are numbered by partition and place, without a count over all data.

Defined cases: a null or empty text is a document of the end id alone; a text of any length is cut into as many pieces
as it takes; rows without id and repeated rows are packed like others; an empty table gives an empty result; ties of keys
are ordered by id, length and ids; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from ._scratch import written
from ._text import chunks, mix

LENGTH = 2048
END_ID = 1
BUCKETS, DIMENSIONS, BITS = 256, 3, 16
#: Bytes of ids that are sorted in one task.
PART_BYTES = 16 << 20


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of coordinates (0 to 2**bits - 1) along the Hilbert curve of its dimension."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        one, low = 1 << b, (1 << b) - 1
        for i in range(n):
            high = (x[i] & one) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keys(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents from their ids: hashed counts, damped, of unit length, projected at random."""
    n = len(begins) - 1
    bucket = (mix(ids.astype(np.uint64) + np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)
    vector = np.log1p(np.bincount(np.repeat(np.arange(n), np.diff(begins)) * BUCKETS + bucket, minlength=n * BUCKETS)).reshape(n, BUCKETS)
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
    place = vector @ np.random.default_rng(2048).standard_normal((BUCKETS, DIMENSIONS))
    top = (1 << BITS) - 1
    return hilbert(np.clip((place + 4) / 8 * top, 0, top).round())


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, n, ids (little-endian 16- or 32-bit) of each document, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe.encoder(path)
        kind = "<u2" if encode.small else "<u4"
        for batch in batches:
            for part in chunks(batch.column(1)):
                ids, begins = encode(part)
                key = keys(ids, begins)
                ids = np.insert(ids, begins[1:], END_ID)
                begins = begins + np.arange(len(begins))
                packed = ids.astype(kind)
                data = [packed[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(key), pa.array(np.diff(begins)), pa.array(data, pa.binary())], ["doc_id", "key", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, n long, ids binary")


class _Packer:
    """The open sequence of one partition; ``rows`` collects the pieces of finished sequences."""

    def __init__(self, first: int, length: int, with_ids: bool):
        self.sequence, self.length, self.with_ids = first, length, with_ids
        self.open: list[tuple] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.length - self.filled, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.filled += take
            at += take
            if self.filled == self.length:
                self._close(self.length)

    def _close(self, size: int) -> None:
        """Take ``size`` ids from the open pieces as one sequence."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.open:
            part = ids[: size - offset]
            if len(part):
                wide = part.astype("<u4")
                self.rows.append((doc_id, start, len(part), zlib.crc32(wide.tobytes()), total, self.sequence, offset, wide if self.with_ids else None))
                offset += len(part)
            if len(part) < len(ids):
                rest.append((doc_id, start + len(part), ids[len(part) :], total))
        self.open = rest
        self.filled -= size
        self.sequence += 1

    def finish(self) -> None:
        while self.filled:
            self._close(1 << (self.filled.bit_length() - 1))

    def batch(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows, self.rows = self.rows, []
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
        if self.with_ids:
            columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId() << 40, length, with_ids)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
                if len(packer.rows) >= 2000:
                    yield packer.batch()
            packer.open = [(d, s, i.copy(), t) for d, s, i, t in packer.open]
        packer.finish()
        yield packer.batch()

    tokens = written(tokenised(docs, path), "tokens")
    size = (tokens.agg(F.sum("n")).first()[0] or 0) * np.dtype(kind).itemsize
    parts = math.ceil(size / PART_BYTES) + 1  # grows with the input, so that a task does not
    curve = tokens.repartitionByRange(parts, F.col("key").asc_nulls_last(), F.col("doc_id").asc_nulls_last()).sortWithinPartitions("key", "doc_id", "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return curve.select("doc_id", "ids").mapInArrow(run, schema + (", ids array<long>" if with_ids else ""))
