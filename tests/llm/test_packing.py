import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm import byte_bpe, hilbert_packing
from lodestar.llm._text import chunks
from lodestar.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
ODD = ["", "   ", "\n", " '", "'s", "I'll don't we've  he's\n's 'tis ''s o'clock'd", "x  \t y", "中文 ² é́ 　a", "a<|endoftext|>b", "1234 ab12", "it's'll"]


def test_ids_are_those_of_the_library(words):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = ODD + ["".join(rng.choice(list("ab 1'  \n\tstrevlmd.,é 　中😀́²"), rng.integers(0, 60))) for _ in range(2000)] + [words(1, 3000)]
    encode = byte_bpe.Encoder(PATH)
    got = []
    for group in (texts[:9], texts[9:]):  # the special token's text sends its whole chunk another way
        for part in chunks(pa.array(group)):
            ids, begins = encode(part)
            got += [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)]
    assert got == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [2, 3])
def test_hilbert_curve_visits_neighbours(n):
    side = np.arange(8)
    points = np.stack(np.meshgrid(*[side] * n), axis=-1).reshape(-1, n)
    key = hilbert_packing.hilbert(points, 3)
    assert sorted(key) == list(range(8**n))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_pieces_cover_documents_and_fill_sequences(docs, words):
    rows = [(i, words(i, int(40 + i * 13 % 700))) for i in range(60)] + [(100, ""), (101, None), (None, "x"), (102, words(5, 9000)), (7, words(7, 50))]
    found = hilbert_packing.pack(docs(rows), PATH, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    pieces = []
    for (_, total), group in by_doc.items():
        group.sort(key=lambda r: r.start)
        assert [r.start for r in group] == np.cumsum([0, *[r.length for r in group[:-1]]]).tolist() and sum(r.length for r in group) == total
        pieces.append(np.array([i for r in group for i in r.ids], "<u4").tobytes())
    assert sorted(pieces) == want
    for group in by_sequence.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == np.cumsum([0, *[r.length for r in group[:-1]]]).tolist()
        size = sum(r.length for r in group)
        assert size <= 2048 and size & (size - 1) == 0


def test_empty(docs):
    assert hilbert_packing.pack(docs([]), PATH).count() == 0
