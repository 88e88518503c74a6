import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer, models  # noqa: E402

from ledgerlark.llm.encoder import WordEncoder, vocabulary_path  # noqa: E402
from ledgerlark.llm.packing import least_slack, op8_pack_sequences, pack  # noqa: E402
from ledgerlark.llm.token_counts import PieceCounter, sentencepiece_vocabulary, token_counts  # noqa: E402

DOCS = [
    (5, "It's a Test, isn't it?\n<|endoftext|> x\x1cy 123 é é ΑΣ ﬁ İ 你好"),
    (1, None),
    (2, ""),
    (None, "null id"),
    (3, "word " * 6000),
    (3, "word " * 6000),
    (7, "abcdefghij" * 300),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in DOCS], "doc_id long, text string, ids string")


def test_words_encoded_one_by_one_equal_whole_texts():
    path = vocabulary_path()
    whole, by_word = Tokenizer.from_file(path), WordEncoder(path, remember=5)
    for _, text in DOCS * 2:
        expected = whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(by_word.encode(text), "<u4").tolist() == expected


def test_piece_counter_equals_word_piece_splitting(spark, docs):
    path = vocabulary_path("piece_bpe_32k.model")
    initial, continuing = sentencepiece_vocabulary(path)
    vocab = {p: i for i, p in enumerate(dict.fromkeys(["[UNK]", *initial, *("##" + p for p in continuing)]))}
    brute = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6, continuing_subword_prefix="##")
    for row in token_counts(docs, path).collect():
        text = dict(DOCS)[row.doc_id] or ""
        words = [w.decode() for w in text.encode().split()]
        assert row.n_words == len(words)
        assert row.n_tokens == sum(len(brute.tokenize(w)) for w in words)
    assert token_counts(docs.limit(0), path).count() == 0


def test_piece_counter_backs_off_and_rejects():
    counter = PieceCounter({"abc", "a", "abcdx"}, {"d", "bc", "b", "c"})
    assert counter.count("abcd") == 2 and counter.count("abcdx") == 1 and counter.count("abcdd") == 3
    assert counter.count("abz") == 0 and counter.count("z") == 0


def test_least_slack_is_the_best_subset_sum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in set(rng.integers(1, 60, 6))}
        room, sums = int(rng.integers(1, 150)), {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = least_slack(counts, sorted(counts, reverse=True), room)
        assert all(0 < k <= counts[n] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def test_query_packs_all_documents_with_little_padding(spark, tmp_path):
    rng = random.Random(9)
    words = ["One", "two,", "<|endoftext|>", "É", "12", "don't", "naïveté.", "x-y", "OF!!"]
    rows = [(k if k % 40 else None, " ".join(rng.choices(words, k=rng.choice([0, 5, 60, 900, 9000])))) for k in range(160)] + [(7, None), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(vocabulary_path())
    got = op8_pack_sequences(spark, str(tmp_path)).collect()
    ids_of = defaultdict(list)
    for d, text in rows:
        ids_of[d].append(np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, all_ids in ids_of.items():  # each piece is one of a document of that doc_id, and they hold its ids as often as it stands there
        assert sum(r.length for r in pieces[d]) == sum(map(len, all_ids))
        for r in pieces[d]:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in all_ids)
        starts = Counter((r.start, r.length, r.doc_tokens) for r in pieces[d])
        assert sum(n * length for (_, length, _), n in starts.items()) == sum(map(len, all_ids))
        assert Counter(len(ids) for ids in all_ids) == Counter(r.doc_tokens for r in pieces[d] if r.start == 0)
    fills = [sum(r.length for r in s) for s in sequences.values()]
    assert max(fills) <= 4096 and sum(4096 - n for n in fills) < 3 * 4096
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]


def test_every_id_is_packed_once(docs):
    whole = Tokenizer.from_file(vocabulary_path())
    rows = pack(docs.coalesce(1), vocabulary_path(), capacity=256, pool=8).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for (doc_id, text), copies in {d: DOCS.count(d) for d in DOCS}.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    full = [sum(r.length for r in s) for s in sequences.values()]
    assert max(full) <= 256 and sum(n < 256 for n in full) <= 1
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]


def test_words_of_letters_and_marks_equal_whole_texts():
    path, rng = vocabulary_path(), random.Random(6)
    whole = Tokenizer.from_file(path)
    letters = "abzAZ" * 3 + "éÉñßçÀœŁıİǆʰͅαΣжδ你0.,'!-_<|>#\x1c\x85"
    for remember in (2, 15, 10**9):  # generations end within, between and never
        by_word = WordEncoder(path, remember=remember)
        for _ in range(800):
            text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) + rng.choice(["", "", ",", ".", ".,"]) for _ in range(rng.randint(0, 9)))
            assert np.frombuffer(by_word.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_count_query_equals_word_piece_splitting(spark, tmp_path):
    from ledgerlark.llm.token_counts import op10_token_counts

    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    initial, continuing = sentencepiece_vocabulary(vocabulary_path("piece_bpe_32k.model"))
    vocab = {p: i for i, p in enumerate(dict.fromkeys(["[UNK]", *initial, *("##" + p for p in continuing)]))}
    brute = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6, continuing_subword_prefix="##")
    expected = Counter()
    for d, text in DOCS:
        pieces = [[t.value for t in brute.tokenize(w.decode())] for w in (text or "").encode().split()]
        expected[d, len(pieces), sum(map(len, pieces)), sum(p == ["[UNK]"] for p in pieces)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in op10_token_counts(spark, str(tmp_path)).collect()) == expected
