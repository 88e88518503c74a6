import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as s


def values(spark, inputs, *functions):
    """The results of column functions over a column ``x`` of strings."""
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    rows = df.select("k", *(f("x").alias(f"v{n}") for n, f in enumerate(functions))).orderBy("k").collect()
    found = [tuple(tuple(v) if hasattr(v, "asDict") else v for v in r[1:]) for r in rows]
    return [v[0] for v in found] if len(functions) == 1 else found


def test_amounts(spark):
    labels = ["$1,001 - $15,000", " $50,001 –  $100,000 ", "$15,000 or Less", "Over $50,000,000", "$50,000,001 +", "$1,000", "None", "", None, "$, - $5", "$1 $2 $3", "$ 5 more"]
    expected = [(1001, 15000, "$1,001 - $15,000"), (50001, 100000, "$50,001 - $100,000"), (0, 15000, "$15,000 or less"), (50000000, None, "$50,000,000 +"), (50000001, None, "$50,000,001 +"), None, None, None, None, None, None, (5, None, "$5 +")]
    assert values(spark, labels, s.parse_amount) == expected


def test_types_and_dates(spark):
    assert values(spark, ["P", " Sale  (Partial). ", "S (partial)", "exchange", "gift", None], s.parse_tx_type) == [("buy", False), ("sell", True), ("sell", True), ("exchange", False), None, None]
    assert values(spark, ["6/2/2026", "06/20/2026", "2026-6-2", "2/30/2026", "6/2/26", "x", None], s.parse_date) == [dt.date(2026, 6, 2), dt.date(2026, 6, 20), dt.date(2026, 6, 2), None, None, None, None]


def test_names(spark):
    names = ["Hon. Osric T. Vantongeren", "Pellwether, Ambrose H.", "A. Thistle Quarrington, Jr.", " sen.  Dr. Jane  Doe III", "Fenwick, Odo, MD", "Senator", ""]
    assert values(spark, names, s.canonical_name) == ["osric t. vantongeren", "ambrose h. pellwether", "a. thistle quarrington", "jane doe", "odo, md fenwick", "", ""]
    assert values(spark, ["osric t. vantongeren", "jane doe"], s.first_last_key) == ["osric vantongeren", "jane doe"]
    assert values(spark, ["a. thistle quarrington", "ab thistle quarrington", "a. b"], s.without_initial) == ["thistle quarrington", None, None]


def test_filing_fields(spark):
    assert values(spark, ["Self", " spouse", "Dependent Child", "Trust", "", None], s.owner_code) == [None, "SP", "DC", "Trust", None, None]
    assert values(spark, ["--", " -BRK-B- ", "", None], s.clean_ticker) == [None, "BRK-B", None, None]
    assert values(spark, ["TX10", "WY00", "CA05", "T10", None], s.state_district) == [("TX", "TX-10"), ("WY", "WY-0"), ("CA", "CA-5"), None, None]
    asset = ["Tarn ETF (QTRN) [EF] F S", "Bills [GS] -", "Odd [ZZ] (A) (B.C)"]
    assert values(spark, asset, s.listed_ticker, s.listed_asset_type, s.plain_asset) == [("QTRN", "ETF", "Tarn ETF"), (None, "Government Security", "Bills"), ("A", "ZZ", "Odd")]
    assert values(spark, [" brk.b ", "BF/B-"], s.market_symbol) == ["BRK-B", "BF-B"]
    assert values(spark, ["Acme  Inc - Class A Common Stock $200?", "New Common Stock", "Beta - Ordinary Shares"], s.company_name) == ["Acme Inc", "", "Beta"]


def test_numbers(spark):
    df = spark.createDataFrame([(12_345_678.0,), (1_250_000.0,), (999_950.0,), (1500.0,), (12.0,)], "x double")
    assert [r[0] for r in df.select(s.money_text("x")).collect()] == ["$12M", "$1.3M", "$1000k", "$2k", "$12"]
    rng = random.Random(3)
    drawn = [1.15, 0.25, 0.35, 2.675, -0.04, -2.5, 1.35 * 0.95, 1e22, 5e-324, 0.0] + [rng.uniform(-1e4, 1e4) for _ in range(500)] + [rng.randrange(-4000, 4000) / 8 for _ in range(500)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(drawn)], "k int, x double")
    for digits in (0, 1, 3, 4):
        assert [r[1] for r in df.select("k", s.exact_round("x", digits)).orderBy("k").collect()] == [round(x, digits) for x in drawn]
    odd = spark.createDataFrame([(float("inf"),), (None,), (float("nan"),)], "x double").select(s.exact_round("x", 1)).collect()
    assert odd[0][0] == float("inf") and odd[1][0] is None and odd[2][0] != odd[2][0]
    assert spark.range(1).select(s.prune_cutoff(F.lit("2026-07-02").cast("date"))).first()[0] == dt.date(2025, 1, 1)


def test_shown_texts(spark):
    assert values(spark, ["  a \n b\t", None, "x" * 600], s.snippet) == ["a b", None, "x" * 500]
    assert values(spark, ["<a href='x'>&\"", None], s.html_escape) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;", ""]
    row = spark.range(1).select(s.us_date(F.lit("2026-03-04").cast("date")), s.buy_share(F.lit(1), F.lit(7)), s.buy_share(F.lit(0), F.lit(0)), s.percent_text(F.lit(0.1234)), s.percent_text(F.lit(0.5), 0)).first()
    assert tuple(row) == ("03/04/2026", 13, 0, "12.3%", "50%")


@pytest.mark.parametrize("mean", [0.0, 0.4, 2.2, 9.5])
def test_poisson(spark, mean):
    got = [r[0] for r in spark.range(31).select(s.poisson_pmf(F.col("id").cast("int"), F.lit(mean))).collect()]
    want = [math.exp(-mean) * mean**k / math.factorial(k) for k in range(31)]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want, strict=True))
