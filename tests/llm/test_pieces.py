"""Words and pieces whose cheap hashes collide are told apart by their bytes."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestar.llm import _pieces, _text, bagminhash, byte_bpe, hilbert_packing, interp_lm, piece_codec
from lodestar.llm.queries import vocabulary


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (1024, 2048, 4096)]


def collide(text, begin, end):
    """A hash that tells spans apart by their lengths modulo three only."""
    return ((end - begin) % 3).astype(np.uint64) + np.uint64(1)


def one(text):
    return next(_text.chunks(pa.array([text])))


def test_spans_against_bytes():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    start = rng.integers(0, 3000, 500)
    end = start + rng.integers(0, 600, 500)
    spans = _text.Spans(data)
    cut = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    again = _text.Spans(np.frombuffer(b"".join(cut), np.uint8))
    ends = np.cumsum([len(c) for c in cut])
    begins = ends - [len(c) for c in cut]
    assert (spans.hashes(start, end) == again.hashes(begins, ends)).all()
    assert len(set(spans.hashes(start, end).tolist())) == len(set(cut))
    turn = rng.permutation(500)
    assert spans.equal(start, end, again, begins[turn], ends[turn]).tolist() == [cut[i] == cut[j] for i, j in enumerate(turn)]
    assert spans.equal(start, end, again, begins, ends).all()


def test_a_cache_of_colliding_hashes_is_right(monkeypatch):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(400)] + [w for p in PAIRS for w in p]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    begin = end - [len(w) for w in words]
    monkeypatch.setattr(_pieces.PieceCache, "hashed", staticmethod(collide))
    for limit in (100, 10_000):
        cache = _pieces.PieceCache(lambda ws: [list(w) for w in ws], limit)
        for _ in range(2):
            found, n = cache.lookup(data, begin, end)
            assert found.tolist() == data.tolist() and n.tolist() == [len(w) for w in words]


@pytest.mark.parametrize("pair", PAIRS)
def test_regular_words_have_their_own_ids_counts_and_classes(spark, docs, pair, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    encode, whole = byte_bpe.Encoder(path), Tokenizer.from_file(path)
    for text in (*pair, " ".join(pair)):
        assert encode(one(text))[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    rows = docs([(3, pair[0]), (4, pair[1])])
    assert len({r.ids_crc32 for r in hilbert_packing.pack(rows, path).collect()}) > 1
    got = {r.doc_id: r for r in piece_codec.round_trip(rows, vocabulary("piece_bpe_32k.model")).collect()}
    assert all(r.parity and r.restored for r in got.values()) and got[3].ids != got[4].ids
    assert {r.doc_id: r.class_id for r in bagminhash.classes(rows).collect()} == {3: 3, 4: 4}
    model, _ = interp_lm.fit_and_score(docs([(0, pair[0]), (2, pair[1])]))
    assert model.distinct == 3  # two words and the end


def test_parity_is_that_of_the_whole_text(docs):
    path = vocabulary("piece_bpe_32k.model")
    own = piece_codec.Codec(path)
    right = own._encode
    own.cache.encode = lambda words: [[*ids, 5] if w == b" wrong" else ids for w, ids in zip(words, right(words), strict=True)]
    part = next(_text.chunks(pa.array(["it is wrong", "all right", "", "wrong", "so it is"])))
    assert own(part)[2].tolist() == [False, True, True, False, True]
