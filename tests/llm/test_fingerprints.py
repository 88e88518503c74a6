import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd

from ledgerlark.llm.fingerprints import Sketch, Version, Words, differing, fingerprints, likeness as near, op5_fingerprints, paragraph_digests
from ledgerlark.llm.ordering import successive, with_successors


def hashed(word):
    return int(pd.util.hash_array(np.array([word], dtype=object), categorize=False)[0])


def paragraphs(text):
    out = []
    for line in text.split("\n"):
        w = line.split(" ")
        ends = [k for k in range(1, len(w)) if len(w) > 8 and hashed(w[k - 1]) % 8 == 0]
        out += [" ".join(w[a:b]) for a, b in zip([0, *ends], [*ends, len(w)], strict=True)]
    return Counter(p for p in out if p)


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 1.0


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 700):
        shared, a, b = (rng.integers(1, 2**64, k, np.uint64) for k in (300, n, n // 2))
        only_a, only_b, _ = differing(Version(np.r_[shared, a]), Version(np.r_[shared, b]))
        assert set(only_a) == set(a) and set(only_b) == set(b)
    assert Sketch.of(rng.integers(1, 2**64, 500, np.uint64), 24).peel() is None


def test_edited_words_are_those_of_the_edited_text():
    rng = random.Random(5)
    texts = ["", " ", "\n", *("".join(rng.choices(["ab", "c", "é", " ", " ", "\n"], k=rng.randrange(60))) for _ in range(60))]
    for text in texts:
        for after in texts:
            cut = len(text) // 4
            head, tail = text[: len(text) - cut], after[:cut]
            got, want = Words.of(text).edited(head, Words.of(after), tail), Words.of(head + tail)
            assert got.hashed.tolist() == want.hashed.tolist() and got.ends.tolist() == want.ends.tolist()


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "é", "a b\n\na b\na b"] + ["\n".join(" ".join(rng.choices("abcdefg", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    rng.shuffle(texts)
    rows = [(3 * k, t, 1) for k, t in enumerate(texts)] + [(9, texts[3], 1), (None, "null \U0001f600 id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    ordered = [rows[-1], *sorted(rows[:-1], key=lambda r: r[0])]
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints(docs).collect())
    expected = Counter()
    for row, after in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, following = row[1] or "", after[1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        expected[row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(text, edited), 9), round(likeness(text, following), 9)] += 1
    assert got == expected
    prints = {}
    for r in fingerprints(docs).collect():
        prints.setdefault(dict((d, t) for d, t, _ in rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_single_row_and_empty_table(spark):
    one = spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")
    (row,) = fingerprints(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"a b c a").hexdigest() and row.near_next == 1.0
    assert fingerprints(one.limit(0)).count() == 0
    (null,) = fingerprints(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert (null.n_chars, null.near_edited) == (0, 1.0)


def test_each_row_meets_its_successor_over_many_parts(spark):
    def run(batches):
        import pyarrow as pa

        rows = list(successive(batches))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "text", "after"])

    ids = random.Random(2).sample(range(10**6), 3000)
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.after for r in with_successors(docs).mapInArrow(run, "doc_id long, text string, after string").collect()}
    ids.sort()
    assert got == {i: str(j) for i, j in zip(ids, [*ids[1:], ids[0]], strict=True)}
    assert len(paragraph_digests("x\nx")) == 2


def test_a_word_put_in_changes_few_digests():
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**4)}" for _ in range(2000)]
    a, b = (Version(paragraph_digests(" ".join(w))) for w in (words, ["new", *words]))
    value, cells = near(a, b)
    assert value > 0.98 and cells == 24 and len(a.digests) > 100


def test_query_has_the_columns_of_the_operator(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b\nc", "x"), (2, None, "y"), (None, "d", "z")], "doc_id long, text string, part string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(map(tuple, op5_fingerprints(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted(map(tuple, fingerprints(docs).collect()), key=str) and len(rows) == 3
