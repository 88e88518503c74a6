import random

from pyspark.sql import functions as F

from ledgerlark.operators import trigrams
from ledgerlark.operators.trigrams import grams, search, write_searchable


def test_searches_equal_a_scan_and_read_few_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    names = ["Ann Lee", "Bo 100%_x", "Éva Ünal", "Cleo (Q.)", None, "", "ab"]
    rows = [(k, rng.choice(names) if k % 9 else f"Member {k // 300}", rng.choice([None, "BRK.B", "Q", f"T{k // 500}"])) for k in range(6000)]
    df = spark.createDataFrame(rows, "id int, member string, ticker string")
    write_searchable(df, f"{tmp_path}/t", ["member", "ticker"], ["id"], block=250)
    for asked in ("lee", "LEE", "%_x", "éva ü", "member 19", "brk.b", "q", "", "zzz", "n l", "T11", "(q.)"):
        plain = [k for k, m, t in rows if asked.lower() in (m or "").lower() or asked.lower() in (t or "").lower()]
        assert sorted(r.id for r in search(spark, f"{tmp_path}/t", ["member", "ticker"], asked).collect()) == plain, asked
    found = search(spark, f"{tmp_path}/t", ["member", "ticker"], "member 19")
    assert "PushedFilters: [In(_block" in found._jdf.queryExecution().toString() or "PushedFilters: [EqualTo(_block" in found._jdf.queryExecution().toString()
    blocks = spark.read.parquet(f"{tmp_path}/t/rows").select("_block").distinct().count()
    assert blocks >= 24
    monkeypatch.setattr(trigrams, "FEW", 1)
    assert sorted(r.id for r in search(spark, f"{tmp_path}/t", ["member"], "lee").collect()) == [k for k, m, _ in rows if "lee" in (m or "").lower()]


def test_grams_of_odd_texts(spark):
    texts = [None, "", "ab", "ABC", "aaaa", "é𝄞ü!"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(grams(F.col("t"))).collect()]
    assert got == [[], [], [], ["abc"], ["aaa"], ["é𝄞ü", "𝄞ü!"]]


def test_empty_table(spark, tmp_path):
    write_searchable(spark.createDataFrame([], "id int, member string"), f"{tmp_path}/t", ["member"])
    assert search(spark, f"{tmp_path}/t", ["member"], "abc").count() == 0
