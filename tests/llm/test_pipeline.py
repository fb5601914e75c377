import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lodestar.llm import queries

from ..conftest import SF


def test_stages_on_small_tables(spark):
    docs = queries.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        assert kept <= set(before)
        if name == "exact dedup":
            bodies = [re.sub(r"[\x20\x09-\x0D]+", " ", before[i]) for i in kept]
            assert len(set(bodies)) == len(bodies)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_oracle_queries(spark):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        df = queries.QUERIES[name](spark, SF).select(*names)
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, found.fetchall())), name


def test_embeddings_of_the_small_table(spark):
    from lodestar.llm import projection_neardup

    rows = queries.table(spark, SF, "embeddings").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = {r.vec_id: int(k) - 1 for r, k in zip(rows, (x @ x.T >= 0.9).sum(axis=1), strict=True)}
    got = {r.vec_id: r.n_links for r in projection_neardup.classes(queries.table(spark, SF, "embeddings")).collect()}
    assert got == n


def odd(spark, words):
    """Documents with nulls, repeats, ties and columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, sha string, _id long, label string, bucket long"
    base = words(1, 80)
    rows = [(i, words(10 + i, 60)) for i in range(30)] + [(100, base), (101, base.replace(" ", "  ")), (102, base + " more"), (103, base), (103, base), (None, base), (None, "alone " * 20), (104, None), (105, ""), (106, " ")]
    return spark.createDataFrame([(i, t, None, None, None, "n", "s", 1, None, 2) for i, t in rows], schema)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, words, stage):
    docs, run = odd(spark, words), dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, SF)
    if stage == "packing":
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        assert run(spark, docs.limit(0), SF).count() == 0
        return
    assert out.columns == docs.columns and out.schema == docs.schema
    kept = [(str(r.doc_id), r.text) for r in out.collect()]
    before = [(str(r.doc_id), r.text) for r in docs.collect()]
    if stage == "exact dedup":
        first = {}
        for i, t in before:
            body = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            if body not in first or (i != "None" and (first[body][0] == "None" or int(i) < int(first[body][0]))):
                first[body] = (i, t)
        before = list(first.values())
    if stage == "MinHash near-dedup":  # rows without id stay, as does the one with the smallest id; texts without words are copies
        before = [x for x in before if x[0] not in ("101", "102", "103", "105", "106")]
    assert sorted(kept, key=str) == sorted(before, key=str)
    assert run(spark, docs.limit(0), SF).count() == 0


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == left and 0 < len(left) < queries.table(spark, SF, "documents").count()
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        size = sum(r.length for r in rows)
        assert size <= 2048 and size & (size - 1) == 0
        assert sorted(r.offset for r in rows) == np.cumsum([0, *[r.length for r in sorted(rows, key=lambda r: r.offset)][:-1]]).tolist()
