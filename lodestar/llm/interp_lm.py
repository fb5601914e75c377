"""Scoring by a bigram language model with deleted interpolation.

P(w | h) = a2(b) c(h w) / c(h) + a1(b) c(w) / N + a0(b) / (V + 1), where b is the bucket of the context's
frequency c(h).  The weights of every bucket are learnt by expectation-maximisation on the held-out part of the
training documents, with counts of the rest; the final counts are those of all training documents.  Held-out tokens are
gathered as distinct (c(h w), c(h), c(w)) with how often they come; the rounds begin where those over a coarse grid of
them end (which the driver solves) and are then taken over all of them, by the executors, until the weights stand still.

No table of n-grams is ever sent to all executors.  Texts are written as groups of blocks; a group asks for the counts of
its distinct n-grams and brings its own counts of them along; n-grams are dealt to shards by hash, a shard adds
up the groups' counts and answers each group; a group with its answers scores its texts, block by block.  Blocks, groups
and shards have a fixed size, so that their numbers grow with the corpus and the memory of a task does not.  A word is
known by a 64-bit digest, of which one bit tells words from pairs.

Defined cases: null text is empty and consists of the end token; a row without id is a training document and not
of the held-out part; repeated rows count and are scored repeatedly; without training documents the model is
uniform over the unknown word; a text of any length is scored as a whole (it is a block of its own); counts are 64-bit
numbers; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import words
from ._scratch import written
from ._text import chunks, distinct, mix

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text in a group of blocks that asks and is answered together (a held-out block is a group of its own).
GROUP_BYTES = 16 << 20
#: Bytes of text for which there is one shard of n-grams.
SHARD_BYTES = 16 << 20
#: Context-frequency buckets: 0, 1, 2 to 3, 4 to 7, ...
BUCKETS = 40
#: Steps of the grid on which expectation-maximisation starts, in a power of ten.
STEPS = 16
_ROUNDS = 60
#: Rounds over all held-out tokens at most, and the change of a weight that ends them.
EXACT_ROUNDS, STILL = 40, 1e-5
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)
_END = np.uint64(0x0E4D0E4D0E4D0E4C)  # even: a token
_BEGIN = np.uint64(0xBE61BE61BE61BE61)  # odd, as pairs are: not a token


def _squeezed(values: np.ndarray) -> bytes:
    """An array's bytes by place (all first bytes, all second bytes, ...), compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if len(raw) else b"")


def _opened(blob: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def blocks(docs: DataFrame, held_remainder: int = 1, parts: int = 5, deleted: int = 10) -> DataFrame:
    """Documents in groups of blocks: training documents of the held-out part (one in ``deleted``), and the others."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    train = F.coalesce(code % parts != held_remainder, F.lit(True))
    part = train & F.coalesce((code / parts).cast("long") % deleted == 0, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        pending: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}
        held: dict[bool, list[tuple]] = {True: [], False: []}  # the blocks of the open groups

        def block(em: bool) -> None:
            rows = pending[em]
            pending[em], size[em] = [], 0
            ids = np.array([0 if r[0] is None else r[0] for r in rows], np.int64)
            flags = np.array([(r[0] is None) + 2 * r[1] for r in rows], np.uint8)
            lengths = np.array([len(r[2]) for r in rows], np.int64)
            text = b"".join(r[2] for r in rows)
            packed = len(text).to_bytes(8, "little") + (pa.compress(text, "zstd", asbytes=True) if text else b"")
            held[em].append((ids.tobytes(), flags.tobytes(), lengths.tobytes(), packed, len(text)))

        def group(em: bool) -> pa.RecordBatch:
            nonlocal number
            number += 1
            *columns, sizes = zip(*held[em], strict=True)
            held[em] = []
            columns = [pa.array([list(c)], pa.list_(pa.binary())) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([first + number]), pa.array([em]), *columns, pa.array([sum(sizes)])], ["group", "em", "ids", "flags", "lengths", "packed", "bytes"])

        for batch in batches:
            for doc_id, trains, em, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, em = (text.as_buffer().to_pybytes() if text.is_valid else b""), em.as_py()
                pending[em].append((doc_id.as_py(), trains.as_py(), text))
                size[em] += len(text)
                if size[em] >= BLOCK_BYTES or len(pending[em]) >= 100_000:
                    block(em)
                    if em or sum(b[-1] for b in held[em]) >= GROUP_BYTES or len(held[em]) >= 16:
                        yield group(em)
        for em in (True, False):
            if pending[em]:
                block(em)
            if held[em]:
                yield group(em)

    rows = docs.select("doc_id", train.alias("train"), part.alias("part"), "text")
    return rows.mapInArrow(run, "group long, em boolean, ids array<binary>, flags array<binary>, lengths array<binary>, packed array<binary>, bytes long")


@dataclass
class Block:
    """A block's tokens as hashes, and where each document's tokens begin."""

    ids: np.ndarray
    no_id: np.ndarray
    train: np.ndarray
    token: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, ids: bytes, flags: bytes, lengths: bytes, packed: bytes) -> Block:
        lengths = np.frombuffer(lengths, np.int64)
        flag = np.frombuffer(flags, np.uint8)
        n = int.from_bytes(packed[:8], "little")
        text = pa.decompress(packed[8:], n, "zstd") if n else pa.py_buffer(b"")
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        column = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), text)
        found = [words(c, lower=True) for c in chunks(column)]
        hashes = np.concatenate([np.zeros(0, np.uint64)] + [h for h, _ in found]) & _EVEN
        begins = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64)] + [np.diff(b) for _, b in found]))]).astype(np.int64)
        return cls(np.frombuffer(ids, np.int64), (flag & 1) > 0, (flag & 2) > 0, np.insert(hashes, begins[1:], _END), begins + np.arange(len(begins)))

    @classmethod
    def all_of(cls, row) -> list[Block]:
        """The blocks of a group's row."""
        return [cls.of(*x) for x in zip(*(row[n] for n in ("ids", "flags", "lengths", "packed")), strict=True)]

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """Each token's value of the token before it; ``first`` for the first of a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.begins[:-1]] = first
        return out

    def placed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct n-grams in order, and where among them each token and each pair stands."""
        pairs = mix(self.before(self.token, _BEGIN) * np.uint64(3) + self.token) | np.uint64(1)
        grams, place = np.unique(np.concatenate([self.token, pairs]), return_inverse=True)
        place = place.astype(np.int32)
        return grams, place[: len(self.token)], place[len(self.token) :]


def _together(rows) -> tuple[np.ndarray, list[tuple[Block, np.ndarray, np.ndarray, np.ndarray]]]:
    """A group's distinct n-grams in order; each block with its places, and where its own n-grams stand in the group's."""
    blocks_ = [(b, *b.placed()) for b in Block.all_of(rows)]
    grams = distinct(np.concatenate([*(own for _, own, _, _ in blocks_), np.array([_BEGIN])]))
    return grams, [(b, np.searchsorted(grams, own), token, pair) for b, own, token, pair in blocks_]


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _asks(shards: int):
    """A group's distinct n-grams with its training counts, a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                grams, blocks_ = _together(row)
                counts = np.zeros(len(grams), np.int64)
                for block, own, token, pair in blocks_:
                    use = np.repeat(block.train, np.diff(block.begins))
                    counts[own] += np.bincount(token[use], minlength=len(own)) + np.bincount(pair[use], minlength=len(own))
                    counts[np.searchsorted(grams, _BEGIN)] += block.train.sum()
                counts = counts.astype(np.uint64)
                shard = _shard(grams, shards)
                cuts = np.flatnonzero(np.diff(shard)) + 1
                edges = [0, *cuts.tolist(), len(grams)]
                rows = [(int(shard[a]), _squeezed(np.diff(grams[a:b], prepend=np.uint64(0))), _squeezed(counts[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([row["group"]] * len(rows), pa.int64()), pa.array([row["em"]] * len(rows)), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "group", "em", "grams", "counts"])

    return run


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's totals: for each group the training counts of its n-grams and what of them is held out.

    A row without group has the shard's numbers: tokens and distinct words, over all and without the held-out part.
    """
    asked = [np.cumsum(_opened(g, np.uint64), dtype=np.uint64) for g in pdf["grams"]]
    sizes = [len(a) for a in asked]
    grams = np.concatenate(asked)
    del asked
    counts = np.concatenate([_opened(c, np.uint64) for c in pdf["counts"]])
    held = np.repeat(pdf["em"].to_numpy(bool), sizes)
    distinct, which = np.unique(grams, return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)  # exact up to 2**53
    part = np.bincount(which[held], weights=counts[held], minlength=len(distinct)).astype(np.int64)
    word = (distinct & np.uint64(1)) == 0
    rest = total - part
    numbers = [total[word].sum(), (total[word] > 0).sum(), rest[word].sum(), (rest[word] > 0).sum()]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    rows = []
    for i, (group, em) in enumerate(zip(pdf["group"], pdf["em"], strict=True)):
        at = which[edges[i] : edges[i + 1]]
        rows.append((group, bool(em), _squeezed(total[at].astype(np.uint64)), _squeezed(part[at].astype(np.uint64)) if em else None, None))
    rows.append((None, False, None, None, [int(x) for x in numbers]))
    out = pd.DataFrame(rows, columns=["group", "em", "counts", "held", "numbers"])
    return out.assign(shard=pdf["shard"].iloc[0], group=out["group"].astype("Int64"))[["shard", "group", "em", "counts", "held", "numbers"]]


_ANSWER = "shard long, group long, em boolean, counts binary, held binary, numbers array<long>"


@dataclass
class Model:
    """Numbers over all training documents, and the weights (pair, word, uniform) of each bucket."""

    tokens: int
    distinct: int
    weights: np.ndarray


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _joined(left: pd.DataFrame, right: pd.DataFrame, held: bool) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray]]:
    """A group's blocks with the counts of their tokens' pairs, contexts and words (``held``: without the held-out part)."""
    grams, blocks_ = _together(left.iloc[0])
    right = right.sort_values("shard")
    counts = np.concatenate([_opened(c, np.uint64) for c in right["counts"]]).astype(np.int64)
    if held:
        counts -= np.concatenate([_opened(c, np.uint64) for c in right["held"]]).astype(np.int64)
    begin = counts[np.searchsorted(grams, _BEGIN)]
    for block, own, token, pair in blocks_:
        told = counts[own]
        word = told[token]
        yield block, told[pair], block.before(word, begin), word


def _gathered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The counts (pair, context, word) of the held-out tokens."""
    names = ["pair", "context", "word"]
    if left.empty:
        return pd.DataFrame({n: [] for n in names}, dtype="int64")
    found = [counts for _, *counts in _joined(left, right, True)]
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*found, strict=True), strict=True)})


def mixture(cell_bucket: np.ndarray, n: np.ndarray, by_pair: np.ndarray, by_word: np.ndarray, uniform: float) -> np.ndarray:
    """Weights of each bucket by expectation-maximisation; a bucket without held-out tokens takes those of all."""

    def solve(n: np.ndarray, p: np.ndarray) -> np.ndarray:
        w = np.where(p.max(axis=0) > 0, 1.0, 0.0)
        w /= w.sum()
        for _ in range(_ROUNDS):
            share = p * w
            w = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
        w = np.maximum(w, [0, 1e-6, 1e-6])
        return w / w.sum()

    p = np.stack([by_pair, by_word, np.full(len(n), uniform)], axis=1)
    out = np.tile(solve(n, p) if len(n) else np.array([0.0, 0.5, 0.5]), (BUCKETS, 1))
    for b in np.unique(cell_bucket):
        at = cell_bucket == b
        out[b] = solve(n[at], p[at])
    return out


def learnt(held: DataFrame, tokens: int, distinct: int) -> np.ndarray:
    """The weights of each bucket from the stored (pair, context, word, n) of held-out tokens."""
    context = F.greatest("context", F.lit(1))
    place = F.least(F.when(F.col("context") > 0, F.floor(F.log2("context")) + 1).otherwise(0), F.lit(BUCKETS - 1))
    rows = held.select(place.cast("int").alias("bucket"), "n", (F.col("pair") / context).alias("p"), (F.col("word") / max(tokens, 1)).alias("q"))
    step = lambda x: F.when(F.col(x) > 0, F.floor(F.log10(x) * STEPS)).otherwise(-99 * STEPS)
    grid = rows.groupBy("bucket", step("p"), step("q")).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("p"), (F.sum(F.col("n") * F.col("q")) / F.sum("n")).alias("q"))
    grid = grid.select("bucket", "n", "p", "q").toPandas().sort_values(["bucket", "p", "q"])  # the grid bounds what comes here, whatever the corpus
    uniform = 1 / (distinct + 1)
    weights = mixture(grid["bucket"].to_numpy(np.int64), grid["n"].to_numpy(float), grid["p"].to_numpy(), grid["q"].to_numpy(), uniform)
    for _ in range(EXACT_ROUNDS if len(grid) else 0):
        own = F.get(F.array(*[F.array(*map(F.lit, w.tolist())) for w in weights]), F.col("bucket"))
        parts = [F.get(own, F.lit(i)) * x for i, x in enumerate((F.col("p"), F.col("q"), F.lit(uniform)))]
        told = rows.select("bucket", "n", *[x.alias(f"w{i}") for i, x in enumerate(parts)])
        told = told.groupBy("bucket").agg(*[(F.sum(F.col("n") * F.col(f"w{i}") / (F.col("w0") + F.col("w1") + F.col("w2"))) / F.sum("n")).alias(f"a{i}") for i in range(3)])
        after = weights.copy()
        for r in told.collect():  # a row for each bucket
            after[r.bucket] = np.maximum([r.a0, r.a1, r.a2], [0, 1e-6, 1e-6])
        after /= after.sum(axis=1, keepdims=True)
        change = np.abs(after - weights).max()
        weights = after
        if change < STILL:
            break
    weights[0, 1:] += weights[0, 0] / 2  # no context, no pair
    weights[0, 0] = 0
    return weights


def _scored(model: Model):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
        out = [pd.DataFrame({c: [] for c in names}).astype({"doc_id": "Int64", "train": "bool", "n_tokens": "int64", "n_known": "int64"})]
        for block, pair, context, word in _joined(left, right, False) if not left.empty else ():
            base = np.log10((word + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
            w = model.weights[bucket(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(model.tokens, 1) + w[:, 2] / (model.distinct + 1)
            begin = block.begins[:-1]
            add = lambda x, begin=begin: np.add.reduceat(x, begin)  # noqa: E731  every document has its end token
            ids = pd.array(block.ids, dtype="Int64")
            ids[block.no_id] = pd.NA
            out.append(pd.DataFrame(dict(zip(names, (ids, block.train, np.diff(block.begins), add((word > 0).astype(np.int64)), add(base), add(np.log10(p))), strict=True))))
        return pd.concat(out[1:] or out)

    return run


def fit_and_score(docs: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model, and for each document doc_id, train, n_tokens, n_known, base_score, score."""
    stored = written(blocks(docs), "blocks")
    size = stored.agg(F.sum("bytes")).first()[0]
    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    if size is None:
        return None, docs.sparkSession.createDataFrame([], schema)
    shards = max(1, math.ceil(size / SHARD_BYTES))
    asks = stored.mapInArrow(_asks(shards), "shard long, group long, em boolean, grams binary, counts binary")
    answers = written(asks.groupBy("shard").applyInPandas(_answers, _ANSWER), "answers")
    numbers = answers.filter("group IS NULL").agg(*[F.sum(F.col("numbers")[i]) for i in range(4)]).first()
    told = answers.filter("group IS NOT NULL").drop("numbers")
    held = stored.filter("em").groupBy("group").cogroup(told.filter("em").groupBy("group"))
    held = held.applyInPandas(_gathered, "pair long, context long, word long")
    held = written(held.groupBy("pair", "context", "word").agg(F.count("*").alias("n")), "held")
    model = Model(numbers[0], numbers[1], learnt(held, numbers[2], numbers[3]))
    return model, stored.drop("em").groupBy("group").cogroup(told.drop("em", "held").groupBy("group")).applyInPandas(_scored(model), schema)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    model, found = fit_and_score(docs)
    tokens = F.lit(model.tokens if model else 0).cast("long")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", tokens.alias("train_tokens"), "base_score", "score")
