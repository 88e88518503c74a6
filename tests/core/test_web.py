import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

import pytest

from ledgerlark.operators.contracts import reachability
from ledgerlark.operators.filings import listing_rows
from ledgerlark.sources import web


class Site(BaseHTTPRequestHandler):
    busy = 2

    def log_message(self, *args):
        return

    def answer(self, status, body=b"", headers=()):
        self.send_response(status)
        for name, value in headers:
            self.send_header(name, value)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        if self.path == "/busy" and Site.busy:
            Site.busy -= 1
            return self.answer(503)
        pages = {"/home": (200, b'<input name="csrfmiddlewaretoken" value="t1">'), "/busy": (200, b"at last"), "/plain": (200, b"no form")}
        if self.path == "/denied":
            return self.answer(403, b"", [("x-deny-reason", "host")])
        return self.answer(*pages.get(self.path, (404, b"")))

    def do_POST(self):
        form = {k: v[0] for k, v in parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()).items()}
        if self.path == "/home":
            return self.answer(200, b"", [("Set-Cookie", "csrftoken=c1")] if form.get("csrfmiddlewaretoken") == "t1" else [])
        if "csrftoken=c1" not in self.headers.get("Cookie", ""):
            return self.answer(403)
        start, n = int(form["start"]), int(form["length"])
        row = lambda k: ["A", str(k), "x", f"<a href='/view/{k}/'>T</a>", "01/02/2026"]
        return self.answer(200, json.dumps({"data": [row(k) for k in range(start, min(start + n, 7))]}).encode())


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_listing_behind_a_handshake(spark, site):
    web.register(spark)
    read = spark.read.format("paged_listing").option("home", f"{site}/home").option("search", f"{site}/search").option("spacing", "0").option("page_rows", "3")
    pages = read.load()
    assert sorted(r.filing_id for r in listing_rows(pages, site).collect()) == [str(k) for k in range(7)]
    with pytest.raises(Exception, match="more than 2 pages"):
        read.option("most_pages", "2").load().collect()
    with pytest.raises(Exception, match="no form token"):
        read.option("home", f"{site}/plain").load().collect()


def test_polite_fetches(spark, site):
    web.register(spark)
    urls = [f"{site}/busy", f"{site}/none", f"{site}/denied", "http://127.0.0.1:1/"]
    got = spark.read.format("polite_fetch").option("urls", "\n".join(urls)).option("spacing", "0").option("backoff", "0").load().cache()
    found = {r.url: (r.status, r.outcome) for r in reachability(got).collect()}
    assert [found[u] for u in urls] == [(200, "reachable"), (404, "reachable"), (403, "blocked"), (None, "unreachable")]
