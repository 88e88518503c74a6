import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlark.__main__ import parse_filings
from ledgerlark.operators import filings as f
from ledgerlark.operators import probability
from ledgerlark.sources import html_tables, readers, sinks
from ledgerlark.streaming import incremental as inc

CODES = {"ST": "Stock", "MF": "Mutual Fund", "CS": "Corporate Security", "CT": "Cryptocurrency", "ZZ": "ZZ"}
KINDS = {"E": ("exchange", False), "P": ("buy", False), "S (partial)": ("sell", True), "S": ("sell", False)}


def drawn_filing(rng, n):
    """A filing of ``n`` rows drawn from the grammar of text filings, and its trades: (owner, asset, ticker, asset_type, type, partial, day, lo, hi)."""
    lines, trades = [], []
    for k in range(n):
        words = [rng.choice(["Quill", "Ombra", "Tarn", "Hollow", "Zephyr", "Lumen"]) for _ in range(rng.randint(1, 5))]
        owner, ticker, code = rng.choice([None, "DC", "JT", "SP"]), rng.choice([None, f"Q{k}", "ZX.A"]), rng.choice([None, *CODES])
        kind, day, low = rng.choice(list(KINDS)), rng.randint(1, 28), rng.randint(1, 900) * 1000 + 1
        marks = "".join(f" {m}" for m in (ticker and f"({ticker})", code and f"[{code}]") if m)
        first = rng.randint(1, len(words))
        head, rest = " ".join(words[:first]), " ".join(words[first:]) + marks
        fields = f"{owner + ' ' if owner else ''}{head} {kind} 03/{day:02}/2026 04/01/2026 "
        form = rng.randrange(3)
        if form == 0:
            lines.append(f"{owner + ' ' if owner else ''}{head} {rest.strip()} {kind} 03/{day:02}/2026 04/01/2026 ${low:,} - ${low + 4999:,}".replace("  ", " "))
        elif form == 1:
            lines += [f"{fields}${low:,} -", f"{rest.strip()} ${low + 4999:,}".strip()]
        else:
            lines += [f"{fields}${low:,} - ${low + 4999:,}", *([rest.strip()] if rest.strip() else [])]
        lines += rng.choice([[], ["D: for the record", "words after a note"], ["F\x00S\x00: New", "S O: Trust Q"], ["* see the list of codes", "Page 2"], ["C: none", "", "  "]])
        trades.append((owner, " ".join(words), ticker, CODES.get(code), *KINDS[kind], day, low, low + 4999))
    return "\n".join(["Filing ID #77", "Name: Someone", *lines, "Digitally Signed: Someone"]), trades


TEXT, TRADES = drawn_filing(random.Random(5), 4)
HTML = """<html><table><tr><td>menu</td></tr></table><table class=x><thead><tr><th>#</th><th>Transaction Date</th><th>Owner</th><th>Ticker</th>
<th>Asset Name</th><th>Asset Type</th><th>Type</th><th>Amount</th></tr></thead>
<tr><td>1.</td><td>05/04/2026</td><td>Spouse</td><td><a href="#">VEGA</a></td><td>Vega &amp; Sons</td><td>Stock</td><td>Purchase</td><td>$1,001 -
 $15,000</td></tr><tr><td>2</td><td>05/05/2026<td>Self</td><td>--</td><td>Bond</td><td></td><td>Sale (Partial)</td><td>Over $50,000,000</td></tr><tr></tr>
<tr><td>Total</td></tr></table>"""
FILING = "chamber string, filing_id string, member string, state string, district string, filing_date date, source_url string, is_paper boolean, text string"


def filing(fid, text, day=dt.date(2026, 6, 20), paper=False, member="Ann Lee"):
    return ("house", fid, member, None, None, day, f"https://x/{fid}", paper, text)


def test_text_filings(spark):
    bad = "Odd Inc P 05/04/2026 05/05/2026 None"
    docs = spark.createDataFrame([filing("f1", TEXT), filing("f2", "nothing here"), filing("f3", TEXT + bad), filing("f4", None)], FILING)
    rows = f.text_trades(docs).orderBy("id").collect()
    good = {r.id: (r.owner, r.asset, r.ticker, r.asset_type, r.type, r.partial, r.tx_date.day, r.amount_lo, r.amount_hi) for r in rows if r.error is None}
    assert good == {f"house:f1:{k}": t for k, t in enumerate(TRADES)}
    assert {r.filing_id: r.error for r in rows if r.error} == {"f2": "no transaction rows", "f3": "unreadable row", "f4": "no transaction rows"}


def test_drawn_text_filings(spark):
    rng = random.Random(11)
    drawn = {f"d{k}": drawn_filing(rng, rng.randint(1, 12)) for k in range(150)}
    docs = spark.createDataFrame([filing(k, text) for k, (text, _) in drawn.items()], FILING)
    got = {r.id: (r.owner, r.asset, r.ticker, r.asset_type, r.type, r.partial, r.tx_date.day, r.amount_lo, r.amount_hi) for r in f.text_trades(docs).collect()}
    assert got == {f"house:{fid}:{k}": t for fid, (_, trades) in drawn.items() for k, t in enumerate(trades)}


def test_page_filings(spark):
    pages = spark.createDataFrame([("s1", HTML), ("s2", "<table><tr><td>1</td><td>short</td></tr></table>"), ("s3", None)], "filing_id string, html string")
    docs = spark.createDataFrame([filing(k, "") for k in ("s1", "s2", "s3")], FILING)
    rows = f.table_trades(docs, html_tables.html_rows(pages, "filing_id")).orderBy("id").collect()
    good = [(r.id, r.owner, r.asset, r.ticker, r.asset_type, r.type, r.partial, r.amount_label) for r in rows if r.error is None]
    assert good == [("senate:s1:0", "SP", "Vega & Sons", "VEGA", "Stock", "buy", False, "$1,001 - $15,000"), ("senate:s1:1", None, "Bond", None, None, "sell", True, "$50,000,000 +")]
    assert {r.filing_id for r in rows if r.error} == {"s2", "s3"}


def test_listing_and_index(spark, tmp_path):
    row = ["Ann ", "Lee", "Office", "<a href='/search/view/paper/ab-1/' target=_blank>Report  for\n May</a>", " 06/20/2026 "]
    pages = [json.dumps({"data": [row, row[:3], [*row[:3], "x", "y"]]}), "{}"]
    got = f.listing_rows(spark.createDataFrame([(p,) for p in pages], "payload string"), "https://h").collect()
    assert tuple(got[0]) == ("ab-1", "Ann Lee", dt.date(2026, 6, 20), "https://h/search/view/paper/ab-1/", True, "Report for May", None)
    assert [r.error for r in got[1:]] == ["row too short", "no report link", "no data"]
    header = "\t".join(readers.INDEX_COLUMNS)
    body = "Hon.\tLee\tAnn\t\tP\tQQ01\t2026\t6/20/2026\t123\n\tFox\tBo\t\tX\tQQ02\t2026\t6/1/2026\t9\n\tShort\tRow\t\tP\tQQ03\t2026\t6/1/2026\n"
    (tmp_path / "i.txt").write_text(f"{header}\n{body}")
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        z.write(tmp_path / "i.txt", "2026FD.txt")
    for index in (readers.read_index(spark, f"{tmp_path}/i.txt"), readers.read_zipped_index(spark, f"{tmp_path}/i.zip")):
        assert [tuple(r) for r in f.index_filings(index, "https://p").collect()] == [("123", "Ann Lee", "QQ", "QQ-1", dt.date(2026, 6, 20), "https://p/2026/123.pdf")]
    (tmp_path / "bad.txt").write_text("Last\tFirst\nx\ty\n")
    with pytest.raises(ValueError, match="without columns"):
        readers.read_index(spark, f"{tmp_path}/bad.txt")


def test_filings_of_both_chambers_make_one_table(spark, tmp_path):
    header = "\t".join(readers.INDEX_COLUMNS)
    (tmp_path / "2026FD.txt").write_text(f"{header}\nHon.\tLee\tAnn\t\tP\tQQ01\t2026\t6/20/2026\t11\nHon.\tFox\tBo\t\tP\tQQ02\t2026\t6/21/2026\t12\n")
    texts = spark.createDataFrame([("11", TEXT), ("12", "scan")], "filing_id string, text string")
    house = f.house_filings(readers.read_yearly_indexes(spark, str(tmp_path), "2026-07-02"), texts, "https://p", readers.layered_text)
    row = ["Ida ", "Moe", "Office", "<a href='/search/view/ptr/ab-1/'>Report</a>", "06/22/2026"]
    listing = f.listing_rows(spark.createDataFrame([(json.dumps({"data": [row, row[:3]]}),)], "payload string"), "https://h")
    senate = f.senate_filings(listing, spark.createDataFrame([("ab-1", HTML)], "filing_id string, html string"))
    both = house.unionByName(senate)
    assert {(r.chamber, r.filing_id, r.is_paper) for r in both.collect()} == {("house", "11", False), ("house", "12", True), ("senate", "ab-1", False)}
    data = inc.Dataset(spark, f"{tmp_path}/data")
    result = inc.run(data, both, parse_filings, members(spark), "2026-07-02", "now")
    assert (result.fetched, result.new_trades, result.paper_skips, result.parse_errors) == (3, 6, 1, 0)
    assert readers.read_yearly_indexes(spark, f"{tmp_path}/none", "2026-07-02").isEmpty()
    sinks.dump_payloads(spark.createDataFrame([("b", "2"), ("a", "1")], "name string, body string"), f"{tmp_path}/dump")
    assert [json.loads(r.value)["name"] for r in spark.read.text(f"{tmp_path}/dump").collect()] == ["a", "b"]


def test_returns_documents(spark, tmp_path):
    gains = spark.createDataFrame([("i1", dt.date(2026, 1, 1), 1.5, 2.0)], "id string, entry_date date, entry_close double, pct double")
    prices = spark.createDataFrame([('Q"x', dt.date(2026, 2, 1), 3.0)], "ticker string, asof_date date, asof_close double")
    assert not sinks.publish_returns_document(gains.limit(0), prices, {}, f"{tmp_path}/r") and sinks.publish_returns_document(gains, prices, {"source": "s"}, f"{tmp_path}/r")
    (tmp_path / "r.json").write_text("".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))))
    for back in (readers.read_returns(spark, f"{tmp_path}/r.json"), readers.read_returns_lines(spark, f"{tmp_path}/r")):
        assert [tuple(r) for r in back["returns"].collect()] == [tuple(gains.first())] and [tuple(r) for r in back["prices"].collect()] == [tuple(prices.first())]
    assert readers.read_returns(spark, f"{tmp_path}/missing.json")["prices"].isEmpty()


def test_prices(spark):
    body = lambda adj: json.dumps({"chart": {"result": [{"timestamp": [1780000000, 1780000060, 1780090000, 1780180000], "indicators": {"quote": [{"close": [1.0, 2.0, None, 4.0]}], **({"adjclose": [{"adjclose": [9.0, None, 8.12345]}]} if adj else {})}}], "error": None}})
    got = readers.read_prices(spark.createDataFrame([("Q", body(False)), ("A", body(True)), ("X", "oops"), ("Y", '{"chart":{"result":null}}')], "ticker string, body string"))
    found = sorted((r.ticker, r.close) for r in got.collect())
    assert found == [("A", 8.12345), ("A", 9.0), ("Q", 2.0), ("Q", 4.0)]


def test_documents_and_datasets(spark, tmp_path):
    roster = {"members": ["note", {"name": "Ann Lee", "chamber": "house", "aliases": ["A. Lee"]}]}
    (tmp_path / "r.json").write_text(json.dumps(roster))
    assert [(r.name, r.aliases) for r in readers.read_roster(spark, f"{tmp_path}/r.json").collect()] == [("Ann Lee", ["A. Lee"])]
    (tmp_path / "f.json").write_text('["B", "A"]')
    assert [r.name for r in readers.read_featured(spark, f"{tmp_path}/f.json").orderBy("position").collect()] == ["B", "A"]
    data = {"meta": {"data_version": "2026-01-01.1"}, "trades": [{"id": "x", "amount_lo": 1, "tx_date": "2026-01-01"}], "skipped_filings": []}
    (tmp_path / "d.json").write_text(json.dumps(data))
    got = readers.read_json_dataset(spark, f"{tmp_path}/d.json")
    assert got["trades"].first().tx_date == dt.date(2026, 1, 1) and got["meta"].first().data_version == "2026-01-01.1"
    (tmp_path / "s.json").write_text(json.dumps(data | {"meta": {"_sample": True}}))
    assert all(readers.read_json_dataset(spark, f"{tmp_path}/{n}.json")["trades"].isEmpty() for n in ("s", "missing"))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.HTML").write_text("x")
    assert [r.kind for r in readers.read_documents(spark, f"{tmp_path}/docs").collect()] == ["html"]
    (tmp_path / "docs/a.doc").write_text("x")
    with pytest.raises(Exception, match="unknown kind"):
        readers.read_documents(spark, f"{tmp_path}/docs").collect()
    assert [r[0] for r in spark.createDataFrame([("x" * 49 + "  \n",), ("x" * 50,)], "t string").select(readers.layered_text("t")).collect()] == ["", "x" * 50]
    people = [{"name": {"first": "Ann", "last": "Lee", "nickname": "Annie"}, "terms": [{"type": "sen", "state": "QQ", "party": "Other"}, {"type": "rep", "state": "QQ", "district": 4, "party": "Democrat"}]}]
    (tmp_path / "l.json").write_text(json.dumps(people))
    built = readers.build_roster(spark.read.option("multiLine", True).schema(readers.LEGISLATORS).json(f"{tmp_path}/l.json")).first()
    assert tuple(built) == ("Ann Lee", "house", "D", "QQ", "QQ-4", ["Annie Lee", "Lee, Ann", "Lee, Annie"])


def test_match_files_to_reports(spark, tmp_path):
    config = {"meta": {"home": "H", "_note": 1}, "calibration": {"home": {"name": "h", "attack": 1.2}, "away": {"name": "a"}, "_x": 2}, "market": {"odds": [2.0, 3.5, 4.0]}}
    (tmp_path / "h_a.json").write_text(json.dumps(config))
    found = readers.read_matches(spark, f"{tmp_path}/h_a.json")
    got = probability.predict(found).first()
    assert (got.match_id, got.home, got.away, got.lam_home) == ("h_a", "H", "a", round(1.35 * 1.2, 3))
    full = probability.full_results(found, with_knockout=True, samples=2000)
    report = sinks.match_report(full).first().report
    assert [f"[{k}]" in report for k in "123456789K+"] == [True] * 11 and "[5b]" not in report
    result = json.loads(sinks.result_json(full).first().result)
    assert result["match"] == "H vs a" and result["knockout"]["advance"]["home"] > 0.5 and len(result["markets"]["top_scorelines"]) == 7
    plain = probability.full_results(found)
    assert "[K]" not in sinks.match_report(plain).first().report and "knockout" not in json.loads(sinks.result_json(plain).first().result)


def members(spark):
    return spark.createDataFrame([("Annabel Lee", "house", "R", "QQ", "QQ-1", ["Ann Lee"], 0)], "name string, chamber string, party string, state string, district string, aliases array<string>, position int")


def test_incremental_runs(spark, tmp_path):
    data = inc.Dataset(spark, f"{tmp_path}/data")
    go = lambda rows, day="2026-07-02", **k: inc.run(data, spark.createDataFrame(rows, FILING).withColumn("listed", F.lit(0)), f.text_trades, members(spark), day, f"{day}T00:00:00Z", **k)
    first = [filing("f1", TEXT), filing("bad", "x"), filing("p", None, paper=True), filing("old", TEXT, dt.date(2024, 12, 31))]
    r = go(first, featured=["Ann Lee", "Other"])
    assert (r.changed, r.fetched, r.new_trades, r.paper_skips, r.parse_errors, r.version) == (True, 3, 4, 1, 1, "2026-07-02.1")
    assert {(t.member, t.party, t.district) for t in data.read("trades").collect()} == {("Annabel Lee", "R", "QQ-1")}
    assert {(s.filing_id, s.reason, s.member) for s in data.read("skipped_filings").collect()} == {("bad", "parse_error", "Annabel Lee"), ("p", "paper", "Annabel Lee")}
    assert {p.filing_id for p in data.read("processed").collect()} == {"f1", "p"}
    meta = data.read("meta").first()
    assert tuple(meta.counts) == (4, 1, 2, 2) and meta.featured == ["Annabel Lee", "Other"]
    again = go(first)
    assert (again.changed, again.fetched, data.latest()) == (False, 1, 1)
    r = go([filing("bad", TEXT)])
    assert (r.recovered_errors, r.new_trades, r.version) == (1, 4, "2026-07-02.2")
    assert [s.filing_id for s in data.read("skipped_filings").collect()] == ["p"]
    assert [tuple(p)[:3] for p in inc.planned(data, spark.createDataFrame([filing("f1", TEXT), filing("next", TEXT)], FILING), "2026-07-02").collect()] == [("house", "next", "Ann Lee")]
    assert [tuple(c) for c in inc.processed_by_chamber(data.read("processed")).collect()] == [("house", 3)]
    later = go([filing("n", TEXT, dt.date(2028, 1, 5))], "2028-01-06")
    assert (later.pruned_trades, later.new_trades, later.version) == (8, 4, "2028-01-06.1")


def test_stream_of_filings(spark, tmp_path):
    data = inc.Dataset(spark, f"{tmp_path}/data")
    feed = lambda n, rows: spark.createDataFrame(rows, FILING).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    read = lambda: spark.readStream.schema(FILING).parquet(f"{tmp_path}/in/*")
    go = lambda: inc.run_stream(data, read(), f.text_trades, members(spark), "2026-07-02", "now", f"{tmp_path}/check")
    feed(1, [filing("f1", TEXT), filing("bad", "x")])
    go()
    feed(2, [filing("bad", TEXT)])
    go()
    go()
    assert data.read("trades").count() == 8 and data.read("skipped_filings").isEmpty() and data.latest() == 2


def test_old_versions_go(spark, tmp_path):
    data = inc.Dataset(spark, f"{tmp_path}/data")
    empty = {name: spark.createDataFrame([], schema) for name, schema in inc.TABLES.items()}
    for k in range(1, 6):
        assert data.write(empty, keep=2) == k
    assert data.versions() == [5, 4, 3] and data.latest() == 5


def test_published_documents(spark, tmp_path):
    trades = spark.createDataFrame([(f"t{k}", f"m{k % 3}", dt.date(2026, 1, 1 + k % 5), dt.date(2026, 2, 1 + k % 2), None) for k in range(40)], "id string, member string, tx_date date, filing_date date, ticker string").repartition(4)
    skipped = spark.createDataFrame([("a", dt.date(2026, 1, 1)), ("b", dt.date(2026, 1, 1)), ("c", dt.date(2026, 1, 2))], "filing_id string, filing_date date")
    sinks.publish_document(trades, skipped, spark.createDataFrame([("2026-01-01.1", 40)], "data_version string, n int"), f"{tmp_path}/doc")
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
    assert whole["meta"] == {"data_version": "2026-01-01.1", "n": 40} and [s["filing_id"] for s in whole["skipped_filings"]] == ["c", "b", "a"]
    assert whole["trades"] == sorted(whole["trades"], key=lambda t: (-dt.date.fromisoformat(t["filing_date"]).toordinal(), t["member"], -dt.date.fromisoformat(t["tx_date"]).toordinal(), t["id"])) and len(whole["trades"]) == 40
    assert whole["trades"][0]["ticker"] is None
    sinks.publish_document(trades.limit(0), skipped.limit(0), spark.createDataFrame([("x",)], "data_version string"), f"{tmp_path}/none")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))["trades"] == []
    sinks.publish_roster(members(spark), f"{tmp_path}/roster")
    (tmp_path / "roster.json").write_text("".join(p.read_text() for p in sorted((tmp_path / "roster").glob("part-*"))))
    assert [r.name for r in readers.read_roster(spark, f"{tmp_path}/roster.json").collect()] == ["Annabel Lee"]
    sinks.publish_lines(trades, skipped, f"{tmp_path}/lines")
    back = readers.read_json_lines(spark, f"{tmp_path}/lines")
    assert back["trades"].count() == 40 and back["skipped_filings"].count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    assert sinks.publish(rows, f"{tmp_path}/p") and not sinks.publish(rows, f"{tmp_path}/q", spark.read.parquet(f"{tmp_path}/p"))
    assert not sinks.publish_returns(rows.limit(0), f"{tmp_path}/r") and sinks.publish_returns(rows, f"{tmp_path}/r")
    sinks.json_lines(rows, f"{tmp_path}/j", ["k"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/j").collect()] == ['{"k":1,"v":"a"}', '{"k":2,"v":"b"}']


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 01:00:00", "view", 1.0), ("2024-01-01 02:00:00", "view", 2.0), ("2024-01-02 02:00:00", "click", 3.0)], "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) ts", "event_type", "value").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    inc.windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_type, r.n, r.value) for r in spark.table("counts").collect()) == [("click", 1, 3.0), ("view", 2, 3.0)]


def test_a_run_without_news_leaves_no_version_and_writes_tables_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from ledgerlark.operators.filings import TRADE_COLUMNS
    from ledgerlark.sources.readers import TRADE_SCHEMA
    from ledgerlark.streaming import incremental

    labels, saved = [], incremental.saved
    monkeypatch.setattr(incremental, "saved", lambda df, label: labels.append(label) or saved(df, label))
    listed = spark.createDataFrame([("house", "f1", "A B", None, None, "2001-07-01", "https://x/1", True)], "chamber string, filing_id string, member string, state string, district string, filing_date string, source_url string, is_paper boolean")
    listed = listed.withColumn("filing_date", F.col("filing_date").cast("date"))
    members = spark.createDataFrame([], "name string, chamber string, party string, state string, district string, aliases array<string>, position int")
    data = incremental.Dataset(spark, str(tmp_path / "data"))
    none = lambda rows: spark.createDataFrame([], TRADE_SCHEMA).select(*TRADE_COLUMNS).withColumn("error", F.lit(None).cast("string"))
    results = [incremental.run(data, listed, none, members, "2001-08-01", "now") for _ in range(2)]
    assert [(r.changed, r.fetched, r.version) for r in results] == [(True, 1, "2001-08-01.1"), (False, 0, "")]
    assert data.versions() == [1] and data.read("skipped_filings").count() == 1
    assert not {"trades", "skips", "processed"} & set(labels)
