import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import interp_lm


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def fold(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def rows(words):
    pool = words(0, 60).split()
    rng = np.random.default_rng(1)
    out = [(i, " ".join(rng.choice(pool[: 20 + i % 40], int(rng.integers(1, 60)))) + (" Rare%d É" % i)) for i in range(300)]
    return [*out, (300, None), (301, ""), (302, " \t\n"), (303, "Ab aB AB"), (303, "Ab aB AB")]


def brute(rows):
    """All of the scores by plain counting, with the operator's own weights for each bucket."""
    one, two, held1, held2 = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if fold(i) % 5 != 1:
            w = tokens(t)
            pairs = Counter(zip(["<s>", *w], w, strict=False))
            one.update(w), two.update(pairs), one.update(["<s>"])
            if fold(i) // 5 % 10 == 0:
                held1.update(w), held2.update(pairs), held1.update(["<s>"])
    n, v = sum(one.values()) - one["<s>"], len(one) - 1
    return one, two, held1, held2, n, v


def test_against_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(interp_lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(interp_lm, "GROUP_BYTES", 7000)
    monkeypatch.setattr(interp_lm, "SHARD_BYTES", 4000)
    model, scored = interp_lm.fit_and_score(docs(rows))
    one, two, _, _, n, v = brute(rows)
    assert (model.tokens, model.distinct) == (n, v) and np.allclose(model.weights.sum(axis=1), 1)
    got = {}
    for r in scored.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[303]) == 2
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = 0.0
        for h, x in zip(["<s>", *w], w, strict=False):
            a = model.weights[interp_lm.bucket(np.array([one[h]]))[0]]
            score += math.log10(a[0] * two[h, x] / max(one[h], 1) + a[1] * one[x] / n + a[2] / (v + 1))
        for r in got[i]:
            assert (r.train, r.n_tokens, r.n_known) == (fold(i) % 5 != 1, len(w), sum(one[x] > 0 for x in w))
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_weights_are_those_of_expectation_maximisation(docs, rows):
    model, _ = interp_lm.fit_and_score(docs(rows))
    one, two, held1, held2, n, v = brute(rows)
    n_held = sum(held1.values()) - held1["<s>"]
    left = {x: one[x] - held1[x] for x in one}
    kinds = sum(c > 0 for x, c in left.items() if x != "<s>")
    by_bucket: dict[int, list] = {}
    for i, t in rows:
        if fold(i) % 5 != 1 and fold(i) // 5 % 10 == 0:
            w = tokens(t)
            for h, x in zip(["<s>", *w], w, strict=False):
                c = left[h]
                by_bucket.setdefault(int(interp_lm.bucket(np.array([c]))[0]), []).append([(two[h, x] - held2[h, x]) / max(c, 1), left[x] / (n - n_held), 1 / (kinds + 1)])
    for b, p in by_bucket.items():
        p = np.array(p)
        w = np.where(p.max(axis=0) > 0, 1.0, 0)
        w /= w.sum()
        for _ in range(2000):
            w = (p * w / (p * w).sum(axis=1, keepdims=True)).mean(axis=0)
        if b:
            assert np.abs(model.weights[b] - w).max() < 0.005


def test_empty_and_null_ids(docs):
    assert interp_lm.score(docs([])).count() == 0
    rows = interp_lm.score(docs([(None, "a b"), (1, "a")])).collect()
    assert len(rows) == 2 and all(r.score < 0 and not r.held_out for r in rows if r.doc_id is None)


def test_counts_beyond_32_bits():
    import pandas as pd

    grams = interp_lm._squeezed(np.diff(np.array([2, 3], np.uint64), prepend=np.uint64(0)))
    rows = [(0, 1, False, grams, interp_lm._squeezed(np.array([2**33, 5], np.uint64))), (0, 2, True, grams, interp_lm._squeezed(np.array([2**32, 1], np.uint64)))]
    out = interp_lm._answers(pd.DataFrame(rows, columns=["shard", "group", "em", "grams", "counts"]))
    assert interp_lm._opened(out["counts"][0], np.uint64).tolist() == [3 * 2**32, 6]
    assert interp_lm._opened(out["held"][1], np.uint64).tolist() == [2**32, 1] and out["numbers"][2] == [3 * 2**32, 1, 2**33, 1]


def test_a_long_text(docs, words):
    text = words(9, 300_000)
    (r,) = interp_lm.score(docs([(2, text)])).collect()
    assert r.n_tokens == r.n_known == 300_001 == r.train_tokens and r.score < 0
