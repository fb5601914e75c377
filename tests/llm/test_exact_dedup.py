import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import binary_fuse, exact_dedup


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 20_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    blob = binary_fuse.build(np.concatenate([keys, keys]))
    assert binary_fuse.contains(blob, keys).all()
    others = rng.integers(2**63, 2**64, 50_000, dtype=np.uint64)
    assert binary_fuse.contains(blob, others).mean() < 0.01


ROWS = [(5, "a  b"), (2, "a b"), (9, "a\t\nb"), (1, "c"), (4, None), (3, ""), (None, "a b"), (7, "c "), (8, "x" * 200_000), (6, "x" * 200_000), (1, "c"), (10, "A b"), (None, "only")]


def brute(rows):
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), b in zip(rows, body, strict=True):
        ids = [j for (j, _), c in zip(rows, body, strict=True) if c == b]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("archived", [None, "true", "false", "doc_id % 2 = 0"])
def test_against_brute_force(docs, archived):
    found = exact_dedup.assign(docs(ROWS), F.expr(archived) if archived else None).withColumn("h", F.lower(F.hex("sha"))).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.h) for r in found), key=str) == brute(ROWS)
    kept = {}
    for r in found:
        kept[r.h] = kept.get(r.h, 0) + r.kept
    assert set(kept.values()) == {1}


def test_drop_copies_keeps_columns_and_clashing_names(docs):
    df = docs([(1, "a"), (2, "a "), (3, "b")]).withColumn("_id", F.lit(7)).withColumn("sha", F.lit("x"))
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3]
    df = docs([(1, "a b"), (2, "a\tb"), (2, "z"), (3, "b"), (3, "b"), (None, "b")])
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_copies(df).collect()) == [("1", "a b"), ("2", "z"), ("3", "b")]


def test_empty(docs):
    assert exact_dedup.assign(docs([])).count() == 0
    assert exact_dedup.drop_copies(docs([])).count() == 0


def test_snapshot_screens_a_batch(docs):
    snapshot = exact_dedup.build_snapshot(exact_dedup.digest_rows(docs([(i, f"old {i}") for i in range(500)])))
    rows = exact_dedup.digest_rows(docs([(1000 + i, f"old {i}" if i < 50 else f"new {i}") for i in range(500)]))
    hits = {r.first_id: r.hit for r in exact_dedup.screen(snapshot, rows).collect()}
    assert all(hits[1000 + i] for i in range(50)) and sum(hits.values()) < 70
