import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import hard_negatives as hn
from ledgerlark.llm.hard_negatives import Planes, hard_negatives, integers, scored

SCHEMA = "id long, label long, vector array<long>, is_anchor boolean, row string"


def brute(rows, positives=5, negatives=5, percent=80):
    """All products, sorted."""
    rows = [(k, *r) for k, r in enumerate(rows) if None not in r[:3]]
    out = []
    for k, anchor_id, label, a, is_anchor, _ in rows:
        if not is_anchor:
            continue
        met = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i, j, own) for j, i, own, v, _, _ in rows if j != k and len(v) == len(a))
        for ps, pid, _, _ in [m for m in met if m[3] == label][:positives]:
            found = [(-s, i) for s, i, _, own in met if own != label and percent * -ps <= 100 * -s <= 100 * -ps][:negatives]
            out += [(anchor_id, pid, n + 1, i, -ps, s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def drawn(rng, n, size, most):
    centres = [[rng.randint(-most, most) for _ in range(size)] for _ in range(4)]
    rows = []
    for k in range(n):
        vector = [max(-most, min(most, c + rng.randint(-most // 2 - 1, most // 2 + 1))) for c in rng.choice(centres)]
        rows.append((rng.choice([k, k % 40]), rng.choice([0, 0, 0, 1, 2]), vector, rng.random() < 0.2, "x"))
    return rows


@pytest.mark.parametrize(("most", "seed"), [(3, 1), (200, 2), (10**9, 3)])
def test_equals_all_products(spark, monkeypatch, most, seed):
    for name, size in (("BLOCK_ROWS", 40), ("BLOCK_ANCHORS", 9), ("SLICE", 16)):
        monkeypatch.setattr(hn, name, size)
    rng = random.Random(seed)
    rows = drawn(rng, 150, 6, most)
    rows += [rows[0]] * 30 + [(7, 0, [1, 2], True, "x"), (8, 0, [3, 1], False, "x"), (9, 1, [3, 1], False, "x"), (10, 0, [], True, "x"), (11, 0, [], False, "x"), (12, 1, [], False, "x")]
    rows += [(None, 1, [1] * 6, True, "x"), (5, None, [1] * 6, True, "x"), (5, 1, None, True, "x"), (6, 1, [2] * 6, None, "x")]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), 5, 3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 3)
    assert len(got) > 50


def test_no_rows_and_no_anchors(spark):
    rows = spark.createDataFrame([(1, 0, [1, 2], False, "x"), (2, 0, [1, 2], False, "x")], SCHEMA)
    assert hard_negatives(rows).collect() == [] and hard_negatives(rows.limit(0)).collect() == []


def test_components_become_integers(spark):
    vectors = [[0.5, -0.001, 0.0039], [1.0, None, 2.0], [math.nan], [math.inf], None, []]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    assert [r[0] for r in df.select(integers(F.col("v"))).collect()] == [[128, -1, 0], None, None, None, None, []]


def test_dropped_pairs_could_not_qualify_and_most_are_dropped_early():
    rng = np.random.default_rng(5)
    x, a = rng.integers(-160, 160, (3000, 64)), rng.integers(-160, 160, (20, 64))
    products, asked = x @ a.T, []

    def worth(low, high, anchor):
        asked.append(low.size)
        return high >= 200_000

    row, anchor, score = scored(Planes(x), a, np.ones(products.shape, bool), worth)
    assert sorted(zip(row.tolist(), anchor.tolist(), score.tolist(), strict=True)) == [(i, j, products[i, j]) for i, j in np.argwhere(products >= 200_000).tolist()]
    assert len(row) and asked[-1] < products.size / 50  # the last planes are asked of few pairs


def test_a_very_long_vector(spark):
    rng = random.Random(9)
    rows = [(k, k % 2, [rng.randint(-9, 9) for _ in range(3000)], k == 0, "x") for k in range(6)] + [(9, 1, [9] * 3000, False, "x"), (10, 0, [9] * 3000, False, "x")]
    assert sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
