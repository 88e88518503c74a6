import random
import re
from collections import Counter

from ledgerlark.llm.quality import Limits, clean_documents, line_frequency, measure


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", "\n\n", "\x1c\x85 a"] + ["".join(rng.choices(["a", "b", "É", " ", "\n", "\t", "#", "|x ", "\xa0", "the ", "\U0001f600"], k=rng.randint(1, 120))) for _ in range(500)]
    for t in texts:
        assert measure(t)[:5] == brute(t)


def test_lines_of_many_documents_go_and_depleted_documents_too(spark):
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    common = own("common", 30)
    rows = [(k, f"{common}\n{own(k, 60)}", "a", 1) for k in range(8)]
    rows += [(20 + k, f"{common.upper()} \n{own('s', 25)}", "a", 1) for k in range(2)]  # versions of one document
    rows += [(30, f"{common}\n{common}\n{own(30, 9)}", "a", 1), (31, f"{common}\n{own(31, 60)}", None, 1)]
    rows += [(40 + k, own("copy", 70), "a", 1) for k in range(30)] + [(None, own("copy", 70), "a", 1), (90, None, "a", None), (91, "short", "a", 1), (91, "short", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumnRenamed("x", "line")
    limits = Limits(min_docs=5, share=0.1, keep_share=0.5)
    got = line_frequency(docs, limits)
    kept = {r.doc_id: (r.kept, r.removed_words) for r in got.collect()}
    assert got.count() == len(rows)
    assert all(kept[k] == (True, 30) for k in range(8))
    assert kept[20] == (False, 30) and kept[30] == (False, 60) and kept[31] == (True, 0)
    assert all(kept[40 + k] == (True, 0) for k in range(30)) and kept[None][0] and not kept[90][0] and not kept[91][0]
    for few in (0, 1000):  # common lines brought by digest, and broadcast
        cleaned = clean_documents(docs, limits, few)
        texts = {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()}
        assert texts[3] == (own(3, 60), len(own(3, 60))) and texts[31] == (f"{common}\n{own(31, 60)}", 1)
        assert 20 not in texts and None in texts and cleaned.count() == sum(r.kept for r in got.collect())
    assert line_frequency(docs.limit(0)).count() == 0 and clean_documents(docs.limit(0)).count() == 0


def test_documents_that_share_most_lines_are_distinct(spark):
    line = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    shared = "\n".join(line(f"t{k}", 6) for k in range(30))
    rows = [(k, f"{shared}\n{line(f'own{k}', 60)}", "a") for k in range(200)]
    rows += [(1000 + k, f"{line('b', 6)}\n{line(f'limit{k}', 60)}", "b") for k in range(20)]
    rows += [(2000 + k, f"{line('c', 6)}\n{line(f'above{k}', 60)}", "c") for k in range(21)]
    rows += [(3000 + k, f"{line('d', 6)}\n{line(f'copy{k % 20}', 60)}", "d") for k in range(60)]
    got = {r.doc_id: (r.removed_words, r.kept) for r in line_frequency(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k] == (180, False) for k in range(200))
    assert all(got[1000 + k] == (0, True) for k in range(20))
    assert all(got[2000 + k] == (6, True) for k in range(21))
    assert all(got[3000 + k] == (0, True) for k in range(60))  # exact copies count once


def test_columns_of_clashing_names_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "s", "r", [1], "x"), (2, None, None, None, None, None)], "doc_id long, text string, source string, rest string, own array<int>, host string")
    assert [tuple(r) for r in clean_documents(docs).collect()] == [(1, text, "s", "r", [1], "x")]
    assert line_frequency(docs).count() == 2


def test_pages_of_a_template_are_distinct_documents(spark):
    lines = lambda name, n: "\n".join(f"{name}a{i} {name}b{i} {name}c{i}" for i in range(n))
    rows = [(k, f"{lines('t', 40)}\n{lines(f'own{k}', 1)}", "a", 1) for k in range(400)]
    rows += [(400 + k, lines(f"page{k}", 20), "a", 1) for k in range(3600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    removed = {r.doc_id: (r.removed_words, r.kept) for r in line_frequency(docs).collect()}
    assert all(removed[k] == (120, False) for k in range(400))
    assert all(removed[400 + k] == (0, True) for k in range(3600))


def test_a_line_of_many_documents_is_common_on_a_large_host_too(spark):
    docs = spark.range(21_100).selectExpr(
        "id AS doc_id",
        "concat('own', id, if(id < 1050, '\\nshared by many', ''), if(id >= 2000 AND id < 3000, '\\nshared by fewer lines', '')) AS text",
        "'a' AS source",
    )
    removed = {r.doc_id: r.removed_words for r in line_frequency(docs).collect()}
    assert all(n == (3 if k < 1050 else 0) for k, n in removed.items()) and len(removed) == 21_100
