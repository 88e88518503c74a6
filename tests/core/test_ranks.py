import random
import statistics
from pathlib import Path

import pyarrow.parquet as pq

from ledgerlark.operators import ranks
from ledgerlark.operators.ranks import ranked
from ledgerlark.operators.views import median_return


def drawn(n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.choice([None, 1.5, 1.5, rng.gauss(0, 50)])) for _ in range(n)]
    return [*rows, ("none", None), ("one", 2.0)]


def test_medians_equal_plain_python_when_one_key_has_most_rows(spark):
    rows = drawn(4000)
    got = {r.ticker: (r.median_pct, r.n) for r in median_return(spark.createDataFrame([(*r, "x") for r in rows], "ticker string, pct double, n string").repartition(5), "ticker").collect()}
    for key in {k for k, _ in rows}:
        own = [p for k, p in rows if k == key and p is not None]
        assert got[key] == (statistics.median(own) if own else None, len(own))
    assert len(got) == 6 and median_return(spark.createDataFrame([], "ticker string, pct double"), "ticker").count() == 0


def test_equal_rows_of_one_key_are_spread_over_tasks(spark, monkeypatch):
    written = []
    held = ranks.saved
    monkeypatch.setattr(ranks, "saved", lambda df, label: written.append(held(df, label)) or written[-1])
    df = spark.range(40_000).selectExpr("'k' AS k", "1 AS v").repartition(6)
    assert sorted(r["rank"] for r in ranked(df, "k", "v").filter("rank < 3 OR rank > 39997").collect()) == [0, 1, 2, 39998, 39999]
    sizes = [pq.read_metadata(f).num_rows for f in Path(written[0]._saved_at.removeprefix("file:")).glob("part-*")]
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) < 2 * 5000


def test_nulls_come_first(spark):
    df = spark.createDataFrame([(None, 2), (None, None), ("a", 1), ("a", None)], "k string, v int")
    assert sorted((r.k is None, r.v or 0, r["rank"], r.n) for r in ranked(df, "k", "v").collect()) == [(False, 0, 0, 2), (False, 1, 1, 2), (True, 0, 0, 2), (True, 2, 1, 2)]
