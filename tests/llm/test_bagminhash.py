import collections

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import _pieces, _text, bagminhash
from lodestar.llm._components import components


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**52, 300, dtype=np.uint64)
    a, b = rng.integers(1, 40, 300), rng.integers(0, 40, 300)
    use = b > 0
    text = np.concatenate([np.zeros(300, int), np.ones(use.sum(), int)])
    sig = bagminhash.signatures(text, np.concatenate([e, e[use]]), np.concatenate([a, b[use]]), 2, 20_000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.015


def test_signatures_do_not_depend_on_company():
    e = np.arange(1, 50, dtype=np.uint64)
    w = np.ones(49, int)
    alone = bagminhash.signatures(np.zeros(49, int), e, w, 1, 64)
    text = np.concatenate([np.zeros(49, int), np.ones(3000, int)])
    beside = bagminhash.signatures(text, np.concatenate([e, np.arange(100, 3100, dtype=np.uint64)]), np.ones(3049, int), 2, 64)
    assert (alone[0] == beside[0]).all()


def brute(rows, similarity=0.8):
    bags = []
    for _, t in rows:
        w = (t or "").split()
        bags.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = sum((bags[i] & bags[j]).values())
            if o >= similarity * (sum(bags[i].values()) + sum(bags[j].values()) - o):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near(text, seed, changes):
    rng = np.random.default_rng(seed)
    w = text.split()
    for _ in range(changes):
        w[rng.integers(len(w))] = f"new{rng.integers(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(words):
    out = []
    for g in range(6):
        base = words(g, 150)
        out += [base, base.replace(" ", "  "), *(near(base, 10 * g + k, k % 4) for k in range(8))]
    passage = words(99, 60)
    out += [passage + " " + words(200 + k, 60) for k in range(30)]
    chain = words(500, 120)
    for k in range(6):  # each is like the one before, the last is not like the first
        out.append(chain)
        chain = near(chain, 900 + k, 2)
    out += ["", None, "one two", "one two", "one", "la " * 3000, "la " * 2900, "lo " * 3000]
    return list(enumerate(out))


def test_classes_against_brute_force(docs, rows):
    root = brute(rows)
    first = {}
    for (i, _), r in zip(rows, root, strict=True):
        first[r] = min(first.get(r, i), i)
    got = {r.doc_id: r for r in bagminhash.classes(docs(rows)).collect()}
    assert {i: got[i].class_id for i, _ in rows} == {i: first[r] for (i, _), r in zip(rows, root, strict=True)}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert all(r.class_size == root.count(root[r.doc_id]) for r in got.values())


def test_large_buckets_are_compared_in_blocks(docs, rows, monkeypatch):
    whole = {r.doc_id: r.class_id for r in bagminhash.classes(docs(rows)).collect()}
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", 3)
    assert {r.doc_id: r.class_id for r in bagminhash.classes(docs(rows)).collect()} == whole


def test_pairs_of_a_bucket_are_verified_whatever_their_signatures(spark, docs, words):
    base = words(7, 150)
    frame = docs([(1, base), (2, near(base, 3, 2)), *((i, words(700 + i, 150)) for i in range(3, 30))])
    signed = {}
    for i, text in ((r.doc_id, r.text) for r in frame.collect()):
        hashes, begins = _pieces.words(next(_text.chunks(pa.array([text]))))
        signed[i] = (_text.sequence_keys(hashes, begins)[0], len(text.split()) - 4)
    first = next(i for i in range(3, 30) if signed[i][0] < min(signed[1][0], signed[2][0]))
    rng = np.random.default_rng(0)  # one band in common, and no other slot
    rows = [(signed[i][0], i, signed[i][1], [5, *(1000 * i + k for k in range(35))], rng.bytes(252)) for i in (1, 2, first)]
    nodes = spark.createDataFrame(rows, "node binary, first_id long, size long, bands array<long>, codes binary")
    labels = {bytes(r.node): r.label for r in bagminhash._labels(frame, nodes, 5, 36, 0.8).collect()}
    assert labels[signed[1][0]] == labels[signed[2][0]] and signed[first][0] not in labels


def test_nulls_repeats_and_empty(docs, words):
    t = words(1, 50)
    got = bagminhash.classes(docs([(None, t), (4, t), (4, t), (2, t + " x"), (None, "alone")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in got) == [("2", "2", 4, True), ("4", "2", 4, False), ("4", "2", 4, False), ("None", "2", 4, False), ("None", "None", 1, True)]
    assert bagminhash.classes(docs([])).count() == 0
    df = docs([(1, t), (2, t), (3, words(2, 50))])
    kept = bagminhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("cuts", [[], [1, 1, 4], [2, 5, 6, 9]])
def test_shared_rows_across_batches(cuts):
    keys = [1, 2, 2, 3, 3, 3, 4, 5, 5, 9]
    nodes = [b"%02d" % i for i in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes, pa.binary()), pa.array([1] * 10)], ["bucket", "node", "size"])
    edges = [0, *cuts, 10]
    out = [x for b in bagminhash._shared(iter([batch.slice(a, z - a) for a, z in zip(edges, edges[1:], strict=False)])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
    assert out == [(k, n, nodes[keys.index(k)]) for k, n in zip(keys, nodes, strict=True) if keys.count(k) > 1]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20), (5, 6), (6, 5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 5: 5, 6: 5} | {100 + i: 100 for i in range(31)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
