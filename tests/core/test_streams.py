import io
import json
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from ledgerlark.__main__ import main, parse_filings
from ledgerlark.operators import contracts
from ledgerlark.plans.pdf_files import pdf_file
from ledgerlark.sources import readers, web
from ledgerlark.streaming import incremental

PAGE = "<table><tr><th>Transaction Date</th><th>Amount</th></tr><tr><td>1</td><td>05/04/2026</td><td>Self</td><td>Q{0}</td><td>Quill</td><td>Stock</td><td>Purchase</td><td>$1,001 - $15,000</td></tr></table>"
TEXT = "Filing ID #1\nSP Nova Corp (NV{0}) [ST] P 05/03/2026 05/04/2026 $1,001 - $15,000\nDigitally signed by somebody"


class Sites(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.0"

    def log_message(self, *args):
        return

    def give(self, body, status=200):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        form = {k: v[0] for k, v in parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()).items()}
        start, n, site = int(form["start"]), int(form["length"]), self.server
        site.asked.append(("rows", start, n))
        row = lambda k: ["Ann", f"Lee {k}", "x", f"<a href='/search/view/{'paper' if k == 2 else 'ptr'}/s{k}/'>T</a>", "05/06/2026"]
        self.give(json.dumps({"recordsFiltered": site.rows, "data": [row(k) for k in range(start, min(start + n, site.rows))]}).encode())

    def do_GET(self):
        site, path = self.server, urlsplit(self.path).path
        site.asked.append((path, time.monotonic()))
        if path.startswith("/index/"):
            text = "\t".join(readers.INDEX_COLUMNS) + "".join(f"\r\nHon.\tFox\tBo\t\tP\tTX01\t2026\t5/6/2026\t{k}" for k in range(site.filed if path.endswith("2026") else 0))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                archive.writestr(zipfile.ZipInfo("a.txt"), text)
            return self.give(out.getvalue())
        name = path.rstrip("/").split("/")[-1].removesuffix(".pdf")
        if path.endswith(".pdf"):
            return self.give(pdf_file(TEXT.format(name)) if name != "1" else pdf_file("")) if name not in site.broken else self.give(b"", 404)
        if path.startswith("/search/view/"):
            return self.give(PAGE.format(name).encode())
        if path == "/crumb":
            return self.give(b"a/b")
        if path.startswith("/chart/"):
            return self.give(json.dumps({"chart": {"result": [{"timestamp": [86400], "indicators": {"quote": [{"close": [2.0]}]}}]}}).encode(), 200 if "crumb=a%2Fb" in self.path else 429)
        return self.give(b'{"k": 1}' if path == "/api/k" else b"", 200 if path == "/api/k" else 404)


def serve():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Sites)
    server.rows, server.filed, server.broken, server.asked = 3, 2, {"0"}, []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.at = f"http://127.0.0.1:{server.server_port}"
    return server


@pytest.fixture
def site():
    server = serve()
    yield server
    server.shutdown()


def given(site):
    return {"search": f"{site.at}/search", "from": "01/01/2025", "index": f"{site.at}/index/{{year}}", "first_year": "2025", "last_year": "2026", "spacing": "0", "retries": "0", "page_rows": "2"}


def test_a_restarted_stream_reads_only_what_is_new(spark, site, tmp_path):
    web.register(spark)

    def go():
        site.asked.clear()
        stream = spark.readStream.format("chamber_listings").options(**given(site)).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")

    ids = lambda df: sorted(f"{r.chamber}{r.filing_id}" for r in web.listed_filings(df, site.at, f"{site.at}/pdf").collect())
    assert ids(go()) == ["house0", "house1", "senates0", "senates1", "senates2"]
    site.rows = 6
    assert ids(go()) == ["house0", "house1", *(f"senates{k}" for k in range(6))]
    reads = [a for a in site.asked if a[0] == "rows" and a[1:] != (0, 2)]  # the first page tells how many there are
    assert reads == [("rows", 3, 2), ("rows", 5, 1)]
    site.filed = 3
    assert ids(go()) == ["house0", "house0", "house1", "house1", "house2", *(f"senates{k}" for k in range(6))]
    assert not [a for a in site.asked if a[0] == "rows" and a[1:] != (0, 2)]
    go()
    assert {a[0] for a in site.asked} == {"rows", "/index/2025", "/index/2026"} and len(site.asked) <= 6  # nothing new: only asked


def test_a_stream_of_listings_keeps_a_dataset(spark, site, tmp_path):
    web.register(spark)
    data = incremental.Dataset(spark, f"{tmp_path}/data")
    roster = spark.createDataFrame([(0, "Ann Lee", "senate", "D", "QQ", None, [])], "position int, name string, chamber string, party string, state string, district string, aliases array<string>")

    def go():
        listed = web.listed_filings(spark.readStream.format("chamber_listings").options(**given(site)).load(), site.at, f"{site.at}/pdf")
        incremental.run_stream(data, listed, parse_filings, roster, "2026-06-01", "now", f"{tmp_path}/at", fetch=lambda new: web.fetched_filings(new, spacing="0", retries="0"))
        return sorted(r.id for r in data.read("trades").collect()), sorted((r.filing_id, r.reason) for r in data.read("skipped_filings").collect())

    assert go() == (["senate:s0:0", "senate:s1:0"], [("0", "parse_error"), ("1", "paper"), ("s2", "paper")])
    site.broken, site.rows, site.filed = set(), 4, 3  # the missing file is there, and there is news
    site.asked.clear()
    trades, skipped = go()
    assert trades == ["house:0:0", "house:2:0", "senate:s0:0", "senate:s1:0", "senate:s3:0"] and skipped == [("1", "paper"), ("s2", "paper")]
    assert sorted(a[0] for a in site.asked if a[0].startswith(("/search/view", "/pdf"))) == ["/pdf/2026/0.pdf", "/pdf/2026/2.pdf", "/search/view/ptr/s3/"]


def test_hosts_are_fetched_side_by_side_each_spaced(spark, site):
    other = serve()
    rows = [(k, f"{s.at}/api/k?{k}") for s in (site, other) for k in range(4)] + [(9, None)]
    # two hosts fall into two of many tasks, so they run at once
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    got = web.fetched(spark.createDataFrame(rows, "k int, u string"), "u", spacing="0.5", retries="0").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted((r.k, r.status) for r in got if r.u) == sorted((k, 200) for k in (0, 1, 2, 3) * 2) and [r.status for r in got if r.u is None] == [None]
    times = [[a[1] for a in s.asked] for s in (site, other)]
    assert all(b - a >= 0.25 for own in times for a, b in zip(own, own[1:], strict=False)) and min(t[-1] - t[0] for t in times) > 1.3
    assert max(t[0] for t in times) < min(t[-1] for t in times)
    other.shutdown()
    hosts = web.FetchSource({"urls": "http://a/1\nhttp://b/1\nhttp://a/2"}).reader(None).partitions()
    assert [p.value for p in hosts] == [["http://a/1", "http://a/2"], ["http://b/1"]]


def test_charts_with_one_crumb_for_all(spark, site):
    tickers = spark.createDataFrame([("A.B",), ("C",), ("C",), ("-",)], "ticker string")
    charts = web.price_charts(tickers, f"{site.at}/chart/{{symbol}}?range=2y", f"{site.at}/", f"{site.at}/crumb", spacing="0").collect()
    assert sorted(r.ticker for r in charts) == ["A.B", "C"]
    assert [a[0] for a in site.asked].count("/crumb") == 1 and {a[0] for a in site.asked} == {"/", "/crumb", "/chart/A-B", "/chart/C"}
    assert readers.read_prices(spark.createDataFrame(charts)).filter(F.col("close") == 2.0).count() == 2


def test_commands_fetch_and_check(spark, site, tmp_path, capsys):
    (tmp_path / "sites.json").write_text(json.dumps({"spacing": 0, "retries": 0, "senate": {"search": f"{site.at}/search", "base": site.at}, "house": {"index": f"{site.at}/index/{{year}}", "base": f"{site.at}/pdf"}, "prices": {"chart": f"{site.at}/chart/{{symbol}}", "cookie": f"{site.at}/", "crumb": f"{site.at}/crumb"}}))
    (tmp_path / "roster.json").write_text(json.dumps({"members": [{"name": "Ann Lee", "aliases": []}]}))
    asked = ["fetch", f"{tmp_path}/data", f"{tmp_path}/sites.json", f"{tmp_path}/roster.json", "2026-06-01"]
    assert main([*asked, "--dry-run", "--chamber", "senate"]) == 0 and "senate" in capsys.readouterr().out
    assert main(asked) == 0
    assert sorted(r.id for r in incremental.Dataset(spark, f"{tmp_path}/data").read("trades").collect()) == ["senate:s0:0", "senate:s1:0"]
    assert main(["charts", f"{tmp_path}/data", f"{tmp_path}/sites.json", f"{tmp_path}/charts"]) == 0
    assert spark.read.parquet(f"{tmp_path}/charts").count() == 2
    (tmp_path / "environments.json").write_text(json.dumps({"dev": site.at, "prod": "http://127.0.0.1:1"}))
    (tmp_path / "k.schema.json").write_text('{"required": ["k"]}')
    check = ["check", f"{tmp_path}/environments.json", str(tmp_path), "k"]
    assert main([*check, "/api/k"]) == 0 and main([*check, "/api/k", "--status", "401"]) == 1 and main([*check, "/none", "--env", "dev"]) == 1
    assert "must be JSON" in capsys.readouterr().err
    with pytest.raises(ValueError, match="valid ones: dev, prod"):
        contracts.environment({"dev": "", "prod": ""}, "stg")
