import numpy as np
import pytest
import sentencepiece

from lodestar.llm import piece_codec
from lodestar.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "<s>", "<0x0A>", "   a  b   ", "x▁y", "中文日本 😀́", "tab\tline\n", "a" * 3000, " " * 40]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    return ODD + ["".join(rng.choice(list("ab 1'  \n\tstrevlmd.,é 　中😀́²日"), rng.integers(0, 50))) for _ in range(1500)]


def test_parity_and_round_trip(docs, texts):
    rows = [*enumerate(texts), (-1, None)]
    got = {r.doc_id: r for r in piece_codec.round_trip(docs(rows), PATH).collect()}
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)
    assert [got[i].ids for i in range(len(texts))] == theirs
    assert all(r.parity and r.n_ids == len(r.ids) for r in got.values())
    assert all(got[i].restored for i, t in enumerate(texts) if "▁" not in t) and got[-1].ids == []


def test_decode_frame(docs, texts, spark):
    coded = piece_codec.encode(docs([(i, t) for i, t in enumerate(texts) if "▁" not in t]), PATH)
    out = piece_codec.decode(coded, PATH).collect()
    assert all(r.decoded == texts[r.doc_id] for r in out)
    odd = piece_codec.decode(spark.createDataFrame([(1, None), (2, [5, -7, 10**6, 1]), (3, [])], "doc_id long, ids array<int>"), PATH).collect()
    assert [r.decoded for r in odd] == [None, "\x02", ""]


def test_decode_carries_clashing_columns(spark):
    df = spark.createDataFrame([(1, [5], "x", 2)], "doc_id long, ids array<int>, decoded string, text int")
    out = piece_codec.decode(df, PATH)
    assert out.columns == ["doc_id", "ids", "decoded", "text", "decoded_"] and tuple(out.first())[2:] == ("x", 2, "\x02")


def test_a_long_text(docs, words):
    text = words(3, 200_000)
    (r,) = piece_codec.round_trip(docs([(1, text)]), PATH).collect()
    assert r.parity and r.restored and r.n_ids == len(r.ids) > 200_000


def test_words_are_joined_for_the_library():
    own = piece_codec.Codec(PATH)
    rng = np.random.default_rng(1)
    spaces = [" ", "  ", " " * 3, " " * 40]
    words = [str(rng.choice(spaces)) + "".join(rng.choice(list("abesxy1'\t\n.é\u3000中😀́²"), rng.integers(1, 30))) for _ in range(2000)]
    words += ["none", *spaces, " a" + "b" * 3000]
    words = [words[i].encode() for i in rng.permutation(len(words))]
    right = [own.plain.encode(w.decode().replace(" ", piece_codec.MARKER)).ids for w in words]
    texts, library = [], own.plain

    class Counted:
        def encode_batch_fast(self, batch, **options):
            texts.extend(batch)
            return library.encode_batch_fast(batch, **options)

    own.plain = Counted()
    assert own._encode(words) == right and own._encode([]) == [] and own._encode([b" "]) == [library.encode(piece_codec.MARKER).ids]
    assert len(texts) < len(words) / 10


def test_decode_of_no_letters():
    own = piece_codec.Codec(PATH)
    for ids in ([], [-1, 10**6]):
        data, at = own.decode(np.array(ids, np.int64), np.array([0, 0, len(ids)]))
        assert data.tolist() == [] and at.tolist() == [0, 0, 0]


def test_unigram_model_scores():
    model = piece_codec.PieceModel(pieces=[("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -1.5, 1), ("▁ab", -2.0, 1), ("▁", -3.0, 1)], kind=piece_codec.UNIGRAM)
    tokenizer = piece_codec.rebuilt(model)
    assert tokenizer.encode("ab  a").ids == [3, 1]  # one piece of -2 beats two of -2.5; blanks are merged


def test_empty(docs):
    assert piece_codec.round_trip(docs([]), PATH).count() == 0
