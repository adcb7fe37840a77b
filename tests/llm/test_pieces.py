import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from siltlog.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a  b ", "\n", "a\nb \n c", "aaa aaaa aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語のテキスト", "naïve café é ́x", "🙂🙂 x", "<0x0A> <s> </s> <unk>", "tab\tcr\r\x00", "x" * 3000, "the" * 500]


def _texts(n=1500):
    rng = random.Random(3)
    bits = ["the", "ing", "er", "a", "o", "t", "th", "é", "ß", "!", "12", "-", "\n", " ", "  ", "un", "tion", "ally", "日", "Q"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bpe_equals_the_library():
    own, lib = pieces.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in _texts():
        ids = own.encode(text)
        assert ids == lib.encode(text), text
        assert own.decode(ids) == text


def test_unigram_equals_the_library():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pieces.UNIGRAM
    rng = random.Random(5)
    for p in proto.pieces:
        if p.type == pieces.NORMAL:
            p.score = -5 - 10 * rng.random()
    data = proto.SerializeToString()
    own, lib = pieces.PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    score = lambda ids: sum(proto.pieces[i].score for i in ids)
    for text in _texts():
        ids, want = own.encode(text), lib.encode(text)
        assert ids == want or len(ids) == len(want) and abs(score(ids) - score(want)) < 1e-3 * len(ids), text[:80]


def test_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "word " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = {(r.doc_id, r.n_pieces): r for r in pieces.encode_documents(docs, PATH).collect()}
    assert found[None, 0].ids == [] and found[2, 0].round_trip
    assert all(r.round_trip for r in found.values()) and len(found) == 4
    back = pieces.decode_documents(pieces.encode_documents(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0
