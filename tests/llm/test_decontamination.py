import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlark.llm.decontamination import contamination, decontaminated, joined

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_words(text):
    return re.findall(PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    """Hit words and item ids, by every window at every place."""
    words, hit, found = brute_words(text), set(), set()
    for item, *texts in items:
        for own in map(brute_words, texts):
            k = min(width, len(own))
            windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
            for i in range(len(words)):
                if tuple(words[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(words), hit, sorted(str(i) for i in found if i is not None)


def drawn(rng):
    vocabulary = ["a", "ab", "b", "É", "Und", "x1", "7", "日本", "ñ", "it"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9))), rng.choice([None, "", "Ab b", "x1, 7; it! a"])) for k in range(25)]
    items += [(None, "nul item here now", None), (3, items[3][1], None), (99, None, None)]
    texts = [None, "", " \n", "...", "x1 7 IT\ta", "a" * 5, "ab b " * 4000]
    for _ in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        _, question, _ = rng.choice(items[:25])
        at = rng.randint(0, len(words))
        texts.append(rng.choice([" ", ", ", "\n", "--"]).join([*words[:at], question.upper() if rng.random() < 0.5 else question, *words[at:]]))
    return items, [(k, t, "x") for k, t in enumerate(texts)] + [(None, "nul Item, here now!", "x"), (4, texts[10], "x"), (4, texts[4], "x")]


def test_hits_equal_all_windows_at_all_places(spark):
    items, rows = drawn(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id long, question string, answer string")
    for width, most in ((4, 50_000), (4, 20), (2, 7)):  # the last two need several automata
        got = contamination(docs, benchmark, ("question", "answer"), width=width, most=most).collect()
        assert len(got) == len(rows)
        expected = []
        for doc_id, text, _ in rows:
            n, hit, ids = brute(text, items, width)
            runs = joined((w, w + 1) for w in hit)
            where = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
            expected.append((doc_id, n, [(a, b, where[a][0], where[b - 1][1]) for a, b in runs], ids))
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], list(r.items)) for r in got), key=repr) == sorted(expected, key=repr)


def test_documents_with_a_window_are_removed_by_row(spark):
    rows = [(1, "clean words only", 1), (2, "so One two three, four", 2), (2, "other text of two", 3), (None, "one two three four", 4), (None, None, 5), (5, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    benchmark = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    for most in (50_000, 1):
        assert sorted(r[2] for r in decontaminated(docs, benchmark, width=2, most=most).collect()) == [1, 3, 5, 6]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    assert contamination(docs.limit(0), benchmark).collect() == []
    assert [(r.n_words, r.runs, r["items"]) for r in contamination(docs, benchmark.limit(0)).collect()] == [(3, [], [])]
    assert contamination(docs, benchmark).filter(F.size("runs") == 1).count() == 1
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]
