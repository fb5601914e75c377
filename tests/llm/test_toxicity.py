import zlib

import numpy as np
import pytest

from lodestar.llm import toxicity

BAD = ["idiot", "schweinhund", "moron"]


@pytest.fixture(scope="module")
def rows(words):
    rng = np.random.default_rng(3)
    out = []
    for i in range(600):
        sentences = [words(1000 + i * 7 + k, int(rng.integers(3, 12))) for k in range(int(rng.integers(1, 8)))]
        toxic = i % 5 == 0
        if toxic:
            k = int(rng.integers(len(sentences)))
            sentences[k] += " you " + BAD[i % 3] + ("en" if i % 2 else "") + " really"
        out.append((i, ". ".join(sentences) + ".", int(toxic)))
    return out


def test_held_out_accuracy_and_location(docs, spark, rows):
    df = docs([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, scorer).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.97
    said = toxicity.offending(df, scorer).collect()
    assert {r.doc_id for r in said} >= {i for i, _, y in rows if y and got[i].score > 0.9}
    assert all(any(b in r.sentence for b in BAD) for r in said)
    assert {r.doc_id for r in toxicity.clean(df, scorer).collect()} == {i for i, r in got.items() if not r.predicted}


def test_edge_cases(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    df = docs([(1, None), (2, ""), (None, "x"), (4, "word " * 50_000), (4, "word")])
    scorer = toxicity.fit(df, labels)
    assert [r.score for r in toxicity.score(df, scorer).filter("doc_id IN (1, 2)").collect()] == [0.0, 0.0]
    assert toxicity.score(df, scorer).count() == 5
    empty = docs([])
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_repetition_in_a_sentence_counts_once():
    scorer = toxicity.Scorer(np.ones(toxicity.BUCKETS, np.float32), -3.0)
    import pyarrow as pa

    from lodestar.llm._text import chunks

    one, many = (scorer.documents(next(chunks(pa.array([t]))))[0] for t in ("la", "la " * 500))
    assert one == many


def brute_score(text, scorer):
    """The noisy-or of a text, sentence by sentence, from the weights alone."""
    import re

    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text):
        words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", sentence)
        if not words:
            continue
        found = set()
        for word in words:
            raw = bytes(b + 32 if 65 <= b <= 90 else b for b in word.encode())
            found.add(feature(raw, 0))
            found |= {feature(raw[:k], 0x5A5A5 * k) for k in toxicity.STEMS if len(raw) > k}
        z = sum(float(scorer.weights[f]) for f in found) + scorer.bias
        clean *= 1 - 1 / (1 + np.exp(-z))
    return 1 - clean


def feature(raw, salt):
    from lodestar.llm._text import Spans

    (code,) = Spans(np.frombuffer(raw, np.uint8)).hashes(np.array([0]), np.array([len(raw)]))
    return (int(code) ^ salt) % toxicity.BUCKETS


def test_scores_against_brute_force(docs, spark, rows):
    df = docs([r[:2] for r in rows[:300]])
    scorer = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    assert np.count_nonzero(scorer.weights) > 3
    got = {r.doc_id: r.score for r in toxicity.score(df, scorer).collect()}
    for i, text, _ in rows[:300]:
        assert got[i] == pytest.approx(brute_score(text, scorer), abs=1e-9)


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    column = rng.integers(0, 6, 60).astype(np.int32)
    bags = toxicity.Bags(column, np.sort(rng.integers(0, 20, 60)), np.sort(rng.integers(0, 8, 20)), rng.random(8) < 0.5)
    w = rng.normal(size=7)
    loss, gradient = toxicity.slopes(bags, w, 0.01)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        change = (toxicity.slopes(bags, w + step, 0.01)[0] - toxicity.slopes(bags, w - step, 0.01)[0]) / 2e-6
        assert gradient[k] == pytest.approx(change, abs=1e-6)


def test_executors_count_what_the_driver_would(docs, spark, rows):
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    here = toxicity.train([t for _, t, _ in known], np.array([y for *_, y in known]))
    there = toxicity.fit(docs([r[:2] for r in rows]).repartition(3), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.allclose(here.weights, there.weights, atol=1e-4) and here.bias == pytest.approx(there.bias, abs=1e-4)


def test_the_sample_is_bounded(docs, spark):
    df = docs([(i, "w" * 100 if i else "w" * 5000) for i in range(400)] + [(9, None), (9, "x")])
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(400)] + [(9, 1, "")], "doc_id long, toxic int, text string")
    assert sorted(toxicity.sampled(df, labels, 30).groupBy("toxic").count().collect()) == [(False, 30), (True, 30)]
    rows = toxicity.sampled(df, labels, 300, 6400).collect()
    for y in (True, False):
        assert 0 < sum(len(r.text or "") for r in rows if r.toxic == y) <= 6400
    assert max(len(r.text or "") for r in rows) == 100
