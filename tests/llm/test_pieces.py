import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import pieces
from ledgerlark.llm.encoder import vocabulary_path
from ledgerlark.llm.pieces import Chunk, PieceModel, decode_pieces, encode_pieces, op4_piece_ids, product, scan_states

PATH = vocabulary_path("piece_bpe_32k.model")
ALPHABET = "ab ▁ ▁▁  theingér☃\n你12..,,\x00s"


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


def library_ids(model, text):
    return np.array(model.library.encode(text or ""), "<u4").tobytes()


def test_lattice_path_equals_the_library(model):
    rng = random.Random(1)
    for _ in range(1000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 60)))
        assert model.encode(model.normalize(text)) == library_ids(model, text)


def test_lattice_path_of_short_runs_equals_merging(model):
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choices("theingaosr☃é", k=rng.randint(1, pieces.SHORT)))
        short, pieces.SHORT = pieces.SHORT, 0
        path = model.whole(text)
        pieces.SHORT = short
        assert path == model.merged(text) == model.whole(text)


def test_scan_of_chunks_equals_the_library(model):
    rng, n = random.Random(2), model.longest
    for _ in range(300):
        text = "".join(rng.choices(ALPHABET if rng.random() < 0.5 else "thein", k=rng.randint(1, 200)))
        whole = model.normalize(text)
        for size in (17, 40):
            chunks = [Chunk(model, whole[max(0, s - n) : s + size + n], min(s, n), min(size, len(whole) - s), s + size >= len(whole)) for s in range(0, len(whole), size)]
            states = scan_states([c.matrix() for c in chunks])
            assert b"".join(c.ids(*s) for c, s in zip(chunks, states, strict=True)) == library_ids(model, text)


def test_giant_and_short_documents_come_back(spark, model):
    rng = random.Random(3)
    texts = [None, "", " ", "x  y\n", "theing" * 300, "no▁mark"] + ["".join(rng.choices("aeth ing\né☃", k=rng.choice([10, 700]))) for _ in range(60)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "the " * 200, "x"), (4, texts[4], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for fan in (64, 3):  # one level of matrices, and several
        encoded = encode_pieces(docs, PATH, giant=200, chunk=64, fan=fan)
        got = Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect())
        assert got == Counter((d, library_ids(model, t)) for d, t, _ in rows)
    texts_back = Counter((r.doc_id, r.text) for r in decode_pieces(encoded, PATH).collect())
    assert texts_back == Counter((d, (t or "").replace("▁", " ")) for d, t, _ in rows)
    assert encode_pieces(docs.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, model, tmp_path):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, "x  y é☃"), (None, "null id"), (3, "x  y é☃"), (9, "".join(rng.choices("aeth ing\n", k=40_000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in op4_piece_ids(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256").collect())
    ids = [library_ids(model, t) for _, t in rows]
    assert got == Counter((d, len(x) // 4, zlib.crc32(x), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), x in zip(rows, ids, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=4, max_size=4), st.randoms())
def test_products_of_matrices_are_associative(sizes, rng):
    a, b, c = ([rng.getrandbits(m) for _ in range(n)] for n, m in zip(sizes, sizes[1:], strict=False))
    assert product(product(a, b), c) == product(a, product(b, c))
    for entry in range(sizes[0]):
        for exit_ in range(sizes[3]):
            if product(product(a, b), c)[entry] >> exit_ & 1:
                path = scan_states([a, b, c], entry, exit_)
                assert path[0][0] == entry and path[-1][1] == exit_
                assert all(m[i] >> j & 1 for m, (i, j) in zip((a, b, c), path, strict=True))
                assert all(x[1] == y[0] for x, y in zip(path, path[1:], strict=False))


def test_other_models_than_byte_pair_are_refused(spark, monkeypatch):
    import sentencepiece

    from ledgerlark.llm import pieces

    path = vocabulary_path("piece_bpe_32k.model")
    proto = sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto()
    assert pieces.model_type(proto) == "byte-pair"
    # field 2 (trainer) with field 3 (model_type), or without it
    assert [pieces.model_type(b"\x12\x02\x18" + bytes([k])) for k in (1, 2, 3, 4, 9)] == ["unigram", "byte-pair", "word", "character", "unknown"]
    assert pieces.model_type(b"\x12\x00") == pieces.model_type(b"\x0a\x03abc") == "unigram"
    monkeypatch.setattr(pieces, "model_type", lambda proto: "unigram")
    pieces.piece_model.cache_clear()
    with pytest.raises(ValueError, match="is a unigram model"):
        pieces.encode_pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path)
    pieces.piece_model.cache_clear()


def test_ids_of_chunks_take_two_bytes_on_their_way(spark, model):
    text = "some words to be cut into chunks " * 40
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    traced = pieces._traced(pieces._chunks(docs, PATH, 64), PATH, 64, 4, "<u2").orderBy("chunk").collect()
    ids = b"".join(bytes(r.ids) for r in traced)
    want = model.encode(model.normalize(text))
    assert len(ids) == len(want) // 2 and pieces.recoded(ids, "<u2", "<u4") == want
    assert [bytes(r.ids) for r in encode_pieces(docs, PATH, giant=200, chunk=64, fan=4).collect()] == [want]
