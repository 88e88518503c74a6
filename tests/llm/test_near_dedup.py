import math
import random

import numpy as np

from ledgerlark.llm.near_dedup import SHARED, block_pairs, fewest_matches, near_duplicates, shingle_set, unique_documents


def brute(rows, width, percent):
    """Components by comparing all pairs of shingle sets."""
    import re

    sets = []
    for _, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        n = min(width, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return [(d, len(s), None if d is None else low[find(i)], d is None or d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc_id = [], 100
    texts = [None, "", " \n", "One", "one", "Two words", "two  WORDS", "É x", "é x"]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([6, 20, 60, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 8))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.3 else base
    rng.shuffle(texts)
    for t in texts:
        rows.append((doc_id, t))
        doc_id += rng.randint(1, 5)
    return [*rows, (None, "Two words"), rows[5], rows[5]]


def key(row):
    return tuple((x is None, x) for x in row)


def test_components_equal_all_pairs(spark):
    for seed, width in ((1, 2), (2, 5)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, a int")
        got = sorted((tuple(r) for r in near_duplicates(docs, width=width).collect()), key=key)
        assert got == sorted(brute(rows, width, 80), key=key)


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(3, a), (5, f"{a} more"), (5, b), (9, f"{b} more"), (9, None), (5, b), (None, b)]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, text_a int, _dropped string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=key)
    assert got == sorted(brute(rows, 5, 80), key=key)
    assert sorted((d, c) for d, _, c, _ in got if d == 5) == [(5, 3), (5, 5), (5, 5)]
    kept = unique_documents(docs)
    assert kept.columns == docs.columns and sorted(r.text_a for r in kept.collect()) == [0, 2, 4, 5, 6]


def test_one_doc_id_of_most_rows(spark):
    rows = [(7 if k % 4 else d, t) for k, (d, t) in enumerate(corpus(5))]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()), key=key)
    assert got == sorted(brute(rows, 2, 80), key=key)


def test_very_long_texts(spark):
    rng = random.Random(6)
    base = rng.choices([f"w{i}" for i in range(5000)], k=60_000)
    rows = [(k, " ".join(base[: 60_000 - 3000 * k])) for k in range(8)] + [(20, "short " + " ".join(base[:50]))]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == sorted(brute(rows, 2, 80))


def test_large_groups_are_compared_block_by_block(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(700):
        copy = list(base)
        for _ in range(rng.randint(4, 9)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == sorted(brute(rows, 2, 80))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_bound_is_the_beta_tail():
    rng = np.random.default_rng(0)
    least = fewest_matches(80, 1e-3)
    n = 32
    for m in (least[0] - 1, least[0]):
        draws = rng.beta(m + 1, n - m + 1, 2_000_000)
        assert (np.mean(draws >= 0.8) >= 1e-3) == (m >= least[0])
    assert math.isclose(len(shingle_set("a b a b a", 2)), 2)


def test_blocks_of_one_component_do_not_meet(spark):
    cells = [(1, 7, k) for k in range(16)] + [(1, SHARED, 0)]  # a large component and a few strays
    cells += [(2, SHARED, k) for k in range(3)] + [(3, 5, 0), (3, 5, 1), (3, 9, 0)] + [(4, 8, k) for k in range(5)]
    pairs = [tuple(r) for r in block_pairs(spark.createDataFrame(cells, "band long, owner long, chunk int")).collect()]
    assert len(pairs) == len(set(pairs))
    by_band = {b: sorted(p[1:] for p in pairs if p[0] == b) for b in range(1, 5)}
    assert len(by_band[1]) == 17 and len(by_band[2]) == 6 and by_band[3] == [(5, 0, 9, 0), (5, 1, 9, 0)] and by_band[4] == []


def test_a_large_component_and_strays_equal_all_pairs(spark):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for k in range(600):  # near copies of one text, and near copies of texts that share two thirds of it
        copy = base[:60] + [f"y{k % 3}v{i}" for i in range(30)] if k >= 560 else list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == sorted(brute(rows, 2, 80))
