"""Toxic documents by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its words (and their first
letters, for stems), and a document's score is the noisy-or of its sentences, 1 - prod(1 - p): one toxic
sentence suffices.  Only documents carry labels; the likelihood of the noisy-or trains the sentence scorer,
which then tells where in a document the offending sentences are.

The scorer is fitted on the driver from a sample of the labelled documents: of each class those with the smallest
hashes of their ids, at most ``MAX_FIT`` and at most ``FIT_BYTES`` of text.  The driver never sees their texts: executors
count in how many documents of each class a feature is, the ``MAX_FEATURES`` that tell the classes apart best make the
model, and what comes to the driver are the numbers of these features, sentence by sentence.  Scoring is one pass without
a shuffle, over whole texts.

Defined cases: null or empty text has no sentence and scores 0; documents without label, with a null label
or held out are never learnt from; of contradicting labels the largest counts; without positive or without
negative examples every score is 0; a text of any length is scored as a whole, and learnt from as a whole or not at all;
repeated rows give repeated results, and ties of hashes are ordered by id; an empty table gives an empty result;
:func:`score` reads doc_id and text only, and :func:`clean` carries all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._text import LOWER, Spans, Texts, chunks, distinct, runs

#: Labelled documents of each class that the fit uses at most.
MAX_FIT = 6000
#: Bytes of text of each class that the fit uses at most; texts of more than a 32nd of it are not learnt from.
FIT_BYTES = 24 << 20
#: Buckets of hashed features.
BUCKETS = 1 << 20
#: Lengths of word beginnings that are features beside the whole word.
STEMS = (3, 4, 5, 6)
#: Features that the scorer may use; those that best tell the classes apart are taken.
MAX_FEATURES = 4096

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def features(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and their sentences (numbered from 0 over the chunk); for each sentence its text and byte span's start."""
    data = LOWER[part.data]
    start, end = runs(_LETTER[data], part.offsets)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = _END[data]
    cut[part.offsets] = True
    number = np.cumsum(cut[: len(data)])[start] if len(start) else start
    sentence = np.cumsum(np.concatenate([[False], number[1:] != number[:-1]])) if len(number) else number  # numbers never fall
    hasher = Spans(data)
    mask = np.uint64(BUCKETS - 1)
    found, where = [hasher.hashes(start, end) & mask], [sentence]
    for k in STEMS:
        long = np.flatnonzero(end - start > k)
        found.append((hasher.hashes(start[long], start[long] + k) ^ np.uint64(0x5A5A5 * k)) & mask)
        where.append(sentence[long])
    first = np.concatenate([[True], np.diff(sentence) > 0]) if len(start) else np.zeros(0, bool)
    text = np.searchsorted(part.offsets, start[first], "right") - 1
    return np.concatenate(found).astype(np.int64), np.concatenate(where), text, start[first]


def _once(found: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a sentence once, however often it is repeated there."""
    pair = distinct(sentence.astype(np.int64) * BUCKETS + found)
    return pair % BUCKETS, pair // BUCKETS


@dataclass
class Scorer:
    """Weights by feature bucket, and what every sentence starts from."""

    weights: np.ndarray
    bias: float

    def sentences(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sentence with a word: its probability, its text, and where in the chunk it starts."""
        found, sentence, text, start = features(part)
        use = self.weights[found] != 0
        found, sentence = _once(found[use], sentence[use])
        z = np.bincount(sentence, weights=self.weights[found], minlength=len(text)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), text, start

    def documents(self, part: Texts) -> np.ndarray:
        p, text, _ = self.sentences(part)
        return -np.expm1(np.bincount(text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(part)))


@dataclass
class Bags:
    """Documents as bags of sentences as sets of chosen features: for each feature of a sentence its place among the
    chosen ones and its sentence, for each sentence its document, for each document its label."""

    column: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, part: Texts, index: np.ndarray, toxic: np.ndarray) -> Bags:
        """``index`` has the place of each feature among the chosen ones, or -1."""
        found, sentence, text, _ = features(part)
        use = index[found] >= 0
        found, sentence = _once(found[use], sentence[use])
        return cls(index[found], sentence, text, toxic)

    @classmethod
    def together(cls, parts: list[Bags]) -> Bags:
        sentences = np.cumsum([0] + [len(p.text) for p in parts])
        texts = np.cumsum([0] + [len(p.toxic) for p in parts])
        columns = ([p.column for p in parts], [p.sentence + n for p, n in zip(parts, sentences, strict=False)], [p.text + n for p, n in zip(parts, texts, strict=False)])
        return cls(*(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int32) for c in columns), np.concatenate([np.zeros(0, bool), *[p.toxic for p in parts]]))


def slopes(bags: Bags, w: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood of the labels (with the weights' penalty), and its gradient; the last is the bias."""
    n_texts, n_sentences = len(bags.toxic), len(bags.text)
    z = np.bincount(bags.sentence, weights=w[bags.column], minlength=n_sentences) + w[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clean = np.bincount(bags.text, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n_texts)
    seen = np.maximum(-np.expm1(clean), 1e-9)
    loss = -(np.log(seen[bags.toxic]).sum() + clean[~bags.toxic].sum()) / n_texts + decay / 2 * (w[:-1] ** 2).sum()
    odds = np.where(bags.toxic, -np.exp(clean) / seen, 1.0)
    slope = odds[bags.text] * p / n_texts
    gradient = np.append(np.bincount(bags.column, weights=slope[bags.sentence], minlength=len(w) - 1), slope.sum())
    gradient[:-1] += decay * w[:-1]
    return loss, gradient


def learn(bags: Bags, chosen: np.ndarray, rounds: int = 120, decay: float = 2e-5) -> Scorer:
    """Maximise the likelihood of document labels under the noisy-or (Adam over all bags)."""
    weights = np.zeros(BUCKETS, np.float32)
    if not len(chosen) or not bags.toxic.any() or bags.toxic.all():
        return Scorer(weights, -30.0)
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(bags.toxic.mean() / max(1.0, len(bags.text) / len(bags.toxic)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, gradient = slopes(bags, w, decay)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    weights[chosen] = w[:-1]
    return Scorer(weights, float(w[-1]))


def present(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, as (text, feature)."""
    found, sentence, text, _ = features(part)
    pair = distinct(text[sentence] * BUCKETS + found)
    return pair // BUCKETS, pair % BUCKETS


def telling(with_pos: np.ndarray, with_neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Features by how far their presence in documents separates the classes (chi-square), best first."""
    often = np.flatnonzero(with_pos + with_neg >= 3)
    pos, n = with_pos[often].astype(float), (with_pos[often] + with_neg[often]).astype(float)
    expected = n * n_pos / max(n_pos + n_neg, 1)
    score = (pos - expected) ** 2 / np.maximum(expected * n_neg / max(n_pos + n_neg, 1), 1e-9)
    best = np.argsort(-score, kind="stable")[:MAX_FEATURES]
    return often[best[score[best] > 10.8]]  # one in a thousand by chance


def train(texts: list[str], toxic: np.ndarray) -> Scorer:
    """A scorer from texts that are at hand."""
    toxic = np.asarray(toxic, bool)
    parts = list(chunks(pa.array(texts, pa.string())))
    counts = np.zeros((2, BUCKETS), np.int64)
    for part in parts:
        at, found = present(part)
        np.add.at(counts, (toxic[at + part.first].astype(int), found), 1)
    chosen = telling(counts[1], counts[0], int(toxic.sum()), int((~toxic).sum()))
    index = np.full(BUCKETS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    return learn(Bags.together([Bags.of(p, index, toxic[p.first : p.first + len(p)]) for p in parts]), chosen)


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null id: 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def sampled(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, max_bytes: int = FIT_BYTES) -> DataFrame:
    """The rows (text, toxic) to learn from, stored."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold(F.col("doc_id")) != 0).select("doc_id", (F.col("toxic") > 0).alias("toxic"), F.xxhash64("doc_id").alias("place"))
    first = [known.filter(F.col("toxic") == y).orderBy("place", "doc_id").limit(max_fit) for y in (False, True)]
    keys = written(first[0].union(first[1]), "labelled")  # at most twice max_fit rows
    rows = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.max("text").alias("text"))
    rows = written(rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "sample")
    upto, within = {False: 0, True: 0}, []
    for r in sorted(rows.filter(F.col("bytes") * 32 <= max_bytes).select("place", "doc_id", "toxic", "bytes").collect()):  # at most twice max_fit rows
        upto[r.toxic] += r.bytes
        if upto[r.toxic] <= max_bytes:
            within.append((r.doc_id,))
    within = docs.sparkSession.createDataFrame(within, "doc_id long")
    return written(rows.join(F.broadcast(within), "doc_id").select("text", "toxic"), "fitted")


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, max_bytes: int = FIT_BYTES) -> Scorer:
    """A scorer from the labelled documents outside the held-out fold, within the bounds for each class."""
    sample = sampled(docs, labels, max_fit, max_bytes)
    sizes = dict(sample.groupBy("toxic").count().collect())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for part in chunks(batch.column(0)):
                at, found = present(part)
                number, n = np.unique(found * 2 + toxic[at + part.first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(number // 2), pa.array(np.where(number % 2 == 1, n, 0)), pa.array(np.where(number % 2 == 0, n, 0))], ["feature", "pos", "neg"])

    found = sample.mapInArrow(counted, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()  # BUCKETS rows at most
    counts = np.zeros((2, BUCKETS), np.int64)
    for i, name in enumerate(("neg", "pos")):
        counts[i, found.column("feature").to_numpy()] = found.column(name).to_numpy()
    chosen = telling(counts[1], counts[0], sizes.get(True, 0), sizes.get(False, 0))
    if not len(chosen):
        return Scorer(np.zeros(BUCKETS, np.float32), -30.0)
    index = np.full(BUCKETS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for part in chunks(batch.column(0)):
                bags = Bags.of(part, index, toxic[part.first : part.first + len(part)])
                columns = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((bags.column, "<u2"), (bags.sentence, "<u4"), (bags.text, "<u4"), (bags.toxic, "u1"))]
                yield pa.RecordBatch.from_arrays(columns, ["column", "sentence", "text", "toxic"])

    rows = sample.mapInArrow(bagged, "column binary, sentence binary, text binary, toxic binary").toArrow().to_pylist()
    opened = [Bags(*(np.frombuffer(r[n], kind) for n, kind in (("column", "<u2"), ("sentence", "<u4"), ("text", "<u4"))), np.frombuffer(r["toxic"], bool)) for r in rows]
    return learn(Bags.together(opened), chosen)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(shared.value.documents(part))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def offending(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The sentences at or over ``threshold``: doc_id, sentence (its text), start (bytes before its first word), score."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(1)):
                p, text, start = shared.value.sentences(part)
                stop = np.append(start[1:], len(part.data))
                stop = np.minimum(stop, part.offsets[text + 1])
                hit = np.flatnonzero(p >= threshold)
                said = [part.data[start[i] : stop[i]].tobytes().decode("utf-8", "replace").strip() for i in hit]
                ids = batch.column(0).slice(part.first, len(part)).take(pa.array(text[hit]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(said, pa.string()), pa.array(start[hit] - part.offsets[text[hit]]), pa.array(p[hit])], ["doc_id", "sentence", "start", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence string, start long, score double")


def clean(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents that the scorer does not reject, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(at)):
                yield batch.slice(part.first, len(part)).filter(pa.array(shared.value.documents(part) < 0.5))

    return docs.mapInArrow(run, docs.schema)
