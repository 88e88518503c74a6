import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm import token_index
from ledgerlark.llm.encoder import vocabulary_path
from ledgerlark.llm.token_index import PerfectHash, op3_token_index, read_tokens, seeded, stored_keys, write_tokens


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 10, 1000, 20000):
        hashes = seeded(np.random.default_rng(n).permutation(10**6)[:n], np.arange(n) % 3, 0)
        assert sorted(PerfectHash.of(hashes).slots(hashes).tolist()) == list(range(n))


def holds(got, rows):
    """Whether ``got`` (start, doc_id, n_tokens, crc32 of the ids) are the rows (doc_id, text) by whole-text encoding, one after the other in ascending doc_id order, null first."""
    whole, expected = Tokenizer.from_file(vocabulary_path()), Counter()
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = sorted(got)
    assert Counter(g[1:] for g in got) == expected
    assert [g[0] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]
    order = [(g[1] is not None, g[1] or 0) for g in got]
    assert order == sorted(order)


def made():
    rng = random.Random(1)
    words = ["One", "two,", "<|endoftext|>", "É", "12", "don't"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in rng.sample(range(-500, 10**6), 400)]
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "same"), (10**7 + 2, "same"), (77, "one two"), (77, "three four five six"), (None, "no key"), (None, "no key either"), (None, None)]
    rows += [(5 * 10**6, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(900)]  # one key of most rows
    return rows


def test_every_row_comes_back_with_its_place(spark, tmp_path):
    rows = made()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    write_tokens(docs, f"{tmp_path}/t", vocabulary_path(), shard_ids=300)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = stored_keys(spark, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/payload").select("part").distinct().count() > 2
    holds([(r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in read_tokens(spark, f"{tmp_path}/t", keys).collect()], rows)
    seen = {(r.doc_id, r.occurrence) for r in keys.collect()}
    assert {k for d, k in seen if d is None} == {0, 1, 2} and {k for d, k in seen if d == 5 * 10**6} == set(range(900)) and len(seen) == len(rows)
    asked = spark.createDataFrame([(987654321,), (rows[0][0],)], "doc_id long")
    found = read_tokens(spark, f"{tmp_path}/t", asked)
    assert [(r.doc_id, r.occurrence) for r in found.collect()] == [(rows[0][0], 0)]



def test_keys_read_only_their_buckets_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_index, "BUCKET_KEYS", 32)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text")).repartition(8)
    write_tokens(docs, f"{tmp_path}/t", vocabulary_path(), shard_ids=200)
    payload, index = (spark.read.parquet(f"{tmp_path}/t/{name}") for name in ("payload", "index"))
    assert payload.count() > 50 and index.count() > 50
    spans = payload.groupBy(F.input_file_name()).agg(F.min("shard").alias("low"), F.max("shard").alias("high")).orderBy("low").collect()
    assert all(a.high < b.low for a, b in zip(spans, spans[1:], strict=False))  # a filter on shards prunes files
    spans = index.groupBy(F.input_file_name()).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).orderBy("low").collect()
    assert all(a.high < b.low for a, b in zip(spans, spans[1:], strict=False))
    some = spark.createDataFrame([(7,), (2999,), (5000,)], "doc_id long")
    assert sorted((r.doc_id, r.start) for r in read_tokens(spark, f"{tmp_path}/t", some).collect()) == [(7, 7 * 4), (2999, 2999 * 4)]
    monkeypatch.setattr(token_index, "FEW_KEYS", 2)
    assert sorted((r.doc_id, r.start) for r in read_tokens(spark, f"{tmp_path}/t", some).collect()) == [(7, 7 * 4), (2999, 2999 * 4)]


def test_a_long_text_and_keys_over_many_parts(spark, tmp_path):
    rows = [(5, "word " * 60_000), (5, "two"), *((5, f"n {k}") for k in range(300)), (6, "end")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    holds([(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op3_token_index(spark, str(tmp_path)).collect()], rows)


def test_query_equals_whole_text_encoding(spark, tmp_path):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    holds([(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op3_token_index(spark, str(tmp_path)).collect()], rows)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(docs, f"{tmp_path}/t", vocabulary_path())
    assert read_tokens(spark, f"{tmp_path}/t", docs).count() == 0
