import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from groundcheck.llm.sentencepiece_codec import PieceCodec, _fields, sentencepiece_decode, sentencepiece_encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _size(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def with_map(dummy, squeeze):
    """The model with the library's compiled character map of compatibility forms."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    table = {n: v for n, v, _ in _fields({n: v for n, v, _ in _fields(proto)}[3])}[2]
    spec = b"\x12" + _size(len(table)) + table + bytes([0x18, dummy, 0x20, squeeze])
    with open(PATH, "rb") as f:
        return b"".join(raw for n, _, raw in _fields(f.read()) if n != 3) + b"\x1a" + _size(len(spec)) + spec


@pytest.mark.parametrize("dummy", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_map_like_the_library(dummy, squeeze):
    model = with_map(dummy, squeeze)
    library, codec, rng = sentencepiece.SentencePieceProcessor(model_proto=model), PieceCodec(model), random.Random(1)
    texts = ["".join(rng.choices("aB cd  \t　ＡＢﬁ①é́ x▁ß漢字ｶﾞ!​\n\x01", k=rng.randint(0, 30))) for _ in range(1500)]
    for text, e in zip(texts, codec.encode([t.encode() for t in texts])):
        assert e.ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        pieces = library.encode(text, return_type="proto").pieces
        assert e.begin[1:-1].tolist() == [p.begin for p in pieces]
        assert e.end[1:-1].tolist() == [p.end for p in pieces]


def test_documents(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = {r.row.doc_id: r for r in sentencepiece_encode(docs, PATH).collect()}
    for i, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = found[i]
        assert r.ids == ids and r.decoded == library.decode(ids)
        data = (text or "").encode()
        joined = b"".join(data[a:b] for a, b in zip(r.begin, r.end))
        assert joined == data  # spans follow each other without gap


def test_edges(odd, empty, rows):
    assert sentencepiece_encode(empty, PATH).collect() == []
    assert sentencepiece_encode(odd, PATH).count() == len(rows) + 5
    (e,) = PieceCodec(open(PATH, "rb").read()).encode([b""])
    assert e.ids.tolist() == [1, 2] and e.decoded == "" and np.all(e.end == 0)


def test_ids_decode(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    lists = [library.encode("a ﬁ b\n 漢字", add_bos=True, add_eos=True), [1, 2], [], None]
    docs = spark.createDataFrame(list(enumerate(lists)), "row long, ids array<int>")
    found = {r.row.row: r.decoded for r in sentencepiece_decode(docs, PATH).collect()}
    assert found == {0: library.decode(lists[0]), 1: "", 2: "", 3: ""} and found[0]
    assert sentencepiece_decode(docs.limit(0), PATH).collect() == []
