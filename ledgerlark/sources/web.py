"""Python data sources over HTTP, off until registered: listings behind a token handshake, as tables and as streams, and polite fetches.

The requests to a host are spaced, so each host has one partition, and hosts are asked side by
side. Nothing is assumed of a site but what the options say.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from http.cookiejar import CookieJar
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlencode, urlsplit
from urllib.request import HTTPCookieProcessor, Request, build_opener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ledgerlark.functions import scalars
from ledgerlark.operators import filings
from ledgerlark.operators.scratch import saved
from ledgerlark.sources import pdf, readers

# Manners towards sites, and the size of a listing.
SPACING, TIMEOUT, RETRIES, BACKOFF = 1.0, 30.0, 3, 2.0
RETRIED = (429, 500, 502, 503, 504)
PAGE_ROWS, MOST_PAGES = 100, 200
TOKEN = r"name=['\"]csrfmiddlewaretoken['\"]\s+value=['\"]([^'\"]+)['\"]"


class PoliteClient:
    """GET and POST with cookies, at least ``spacing`` seconds apart; busy and failing servers are asked again."""

    def __init__(self, agent: str, spacing: float = SPACING, timeout: float = TIMEOUT, retries: int = RETRIES, backoff: float = BACKOFF):
        self.cookies = CookieJar()
        self.opener = build_opener(HTTPCookieProcessor(self.cookies))
        self.opener.addheaders = [("User-Agent", agent)]
        self.spacing, self.timeout, self.retries, self.backoff, self.last = spacing, timeout, retries, backoff, 0.0

    def cookie(self, name: str) -> str | None:
        return next((c.value for c in self.cookies if c.name == name), None)

    def request(self, url: str, form: dict | None = None, headers: dict | None = None):
        """(status, headers, body) of the answer; an error status after the last try is raised."""
        data = urlencode(form).encode() if form is not None else None
        for attempt in range(self.retries + 1):
            time.sleep(max(0.0, self.last + self.spacing - time.monotonic()))
            self.last = time.monotonic()
            try:
                with self.opener.open(Request(url, data, headers or {}), timeout=self.timeout) as answer:
                    return answer.status, answer.headers, answer.read()
            except HTTPError as error:
                if error.code not in RETRIED or attempt == self.retries:
                    raise
            time.sleep(self.backoff * 2**attempt)
        raise AssertionError("not reached")


def accept_terms(client: PoliteClient, home: str, field: str = "prohibition_agreement") -> None:
    """Take the form token from ``home``, send it back with the consent, and require the token's cookie."""
    found = re.search(TOKEN, client.request(home)[2].decode("utf-8", "replace"))
    if not found:
        raise ValueError(f"no form token at {home}")
    client.request(home, {"csrfmiddlewaretoken": found[1], field: "1"}, {"Referer": home})
    if client.cookie("csrftoken") is None:
        raise ValueError(f"{home} set no token cookie")


def listing_pages(client: PoliteClient, search: str, form: dict, page_rows: int = PAGE_ROWS, most: int = MOST_PAGES):
    """(page, payload) of a listing, up to the first short page; more than ``most`` full ones are an error."""
    for page in range(most):
        asked = form | {"draw": str(page + 1), "start": str(page * page_rows), "length": str(page_rows)}
        body = client.request(search, asked, {"X-CSRFToken": client.cookie("csrftoken") or ""})[2].decode("utf-8", "replace")
        rows = json.loads(body).get("data")
        if rows is None:
            raise ValueError(f"listing without data: {body[:500]}")
        yield page, body
        if len(rows) < page_rows:
            return
    raise ValueError(f"listing has more than {most} pages")


def _client(options) -> PoliteClient:
    return PoliteClient(options.get("agent", "ledgerlark"), float(options.get("spacing", SPACING)), float(options.get("timeout", TIMEOUT)), int(options.get("retries", RETRIES)), float(options.get("backoff", BACKOFF)))


class _OnePartition(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(0)]


class ListingSource(DataSource):
    """format("paged_listing"): (page, payload), for filings.listing_rows(). Options: home (optional), search, from, to, and manners."""

    @classmethod
    def name(cls):
        return "paged_listing"

    def schema(self):
        return "page int, payload string"

    def reader(self, schema):
        return _ListingReader(self.options)


class _ListingReader(_OnePartition):
    def read(self, partition):
        o, client = self.options, _client(self.options)
        if o.get("home"):
            accept_terms(client, o["home"])
        day = lambda d: f"{d} 00:00:00" if d else ""
        form = {"submitted_start_date": day(o.get("from")), "submitted_end_date": day(o.get("to"))}
        yield from listing_pages(client, o["search"], form, int(o.get("page_rows", PAGE_ROWS)), int(o.get("most_pages", MOST_PAGES)))


class FetchSource(DataSource):
    """format("polite_fetch"): (url, status, body, deny, error) of the addresses in the option urls, one a line; an error is a row, for contracts.reachability(). A partition for each host."""

    @classmethod
    def name(cls):
        return "polite_fetch"

    def schema(self):
        return f"url string, {ANSWER}"

    def reader(self, schema):
        return _FetchReader(self.options)


class _FetchReader(_OnePartition):
    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for url in self.options["urls"].split("\n"):
            hosts.setdefault(urlsplit(url).netloc, []).append(url)
        return [InputPartition(urls) for urls in hosts.values()]

    def read(self, partition):
        client = _client(self.options)
        for url in partition.value:
            yield url, *answer(client, url)


#: What a fetch gives.
ANSWER = "status int, body binary, deny string, error string"


def answer(client: PoliteClient, url: str) -> tuple:
    """ANSWER of one address; what goes wrong is told, not raised."""
    try:
        status, headers, body = client.request(url)
        return status, body, headers.get("x-deny-reason"), None
    except HTTPError as error:
        return error.code, error.read(), error.headers.get("x-deny-reason"), None
    except (URLError, OSError, ValueError) as error:
        return None, None, None, str(error)


def fetched(rows: DataFrame, url: str = "source_url", **manners) -> DataFrame:
    """``rows`` with ANSWER of the address in their column ``url``; null addresses are not asked.

    All addresses of a host go to one task, with a client of its own that keeps its requests apart;
    tasks of different hosts run side by side.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(ANSWER)])
    place = rows.columns.index(url)

    def run(batches):
        import pyarrow as pa

        clients: dict[str, PoliteClient] = {}
        for batch in batches:
            found = []
            for address in batch.column(place).to_pylist():
                host = urlsplit(address or "").netloc
                found.append((None,) * 4 if address is None else answer(clients.setdefault(host, _client(manners)), address))
            columns = zip(*found, strict=True) if found else ((),) * 4
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_host", F.parse_url(F.col(url), F.lit("AUTHORITY"))).repartition(tasks, "_host")
    return dealt.mapInArrow(run, schema)


def fetched_filings(rows: DataFrame, **manners) -> DataFrame:
    """Filings (filings.FILING_COLUMNS) with the text or page that their address gives: PDF files of the house, a scan being a paper filing, and pages of the senate.

    Paper filings are not fetched. One whose address gives an error has neither text nor page, so
    reading it fails and the next run tries again. Answers are written once, so nothing is asked for twice.
    """
    asked = rows.withColumn("_url", F.when(~F.col("is_paper"), F.col("source_url"))).drop("text", "html")
    got = saved(fetched(asked, "_url", **manners), "answers").withColumn("_good", F.col("status").between(200, 299))
    files = got.filter("_good AND chamber = 'house'").select(F.concat_ws(":", "chamber", "filing_id").alias("path"), F.col("body").alias("content"))
    texts = pdf.pdf_texts(files).withColumnsRenamed({"error": "_unread", "path": "_path"})
    out = got.join(texts, F.concat_ws(":", "chamber", "filing_id") == F.col("_path"), "left")
    page = F.when(F.col("_good") & (F.col("chamber") == "senate"), F.decode("body", "UTF-8"))
    scan = F.coalesce((F.col("text") == "") & F.col("_unread").isNull(), F.lit(False))
    return out.withColumns({"html": page, "is_paper": F.col("is_paper") | scan}).select(rows.columns)


class ChamberListings(DataSource):
    """format("chamber_listings"): (chamber, page, payload) of what chambers list, as a table or as a stream.

    Options: ``search`` (and ``home``, ``from``) for the senate's paged listing, ``index`` for the
    house's yearly archives, an address with {year}, with ``first_year`` and ``last_year``; and
    manners. A payload is a JSON document: ``data``, rows of a listing page, or ``index``, rows of INDEX_COLUMNS.

    The stream's offset has an entry for each chamber: how many rows of the listing from ``from`` on
    have been read, in its order, oldest first; and the digest of each year's archive. A trigger reads only the rows
    after those and the archives that have changed, whole; each chamber is one partition. Nothing
    else is kept, so a restarted query goes on where its checkpoint says.
    """

    @classmethod
    def name(cls):
        return "chamber_listings"

    def schema(self):
        return "chamber string, page int, payload string"

    def reader(self, schema):
        return _Listings(self.options)

    def streamReader(self, schema):
        return _ListingStream(self.options)


class _Chambers:
    """What is asked of the chambers' sites; a client is made where it is used."""

    def __init__(self, options):
        self.options, self._open = dict(options), None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def client(self) -> PoliteClient:
        if self._open is None:
            self._open = _client(self.options)
            if self.options.get("home"):
                accept_terms(self._open, self.options["home"])
        return self._open

    def listing(self, start: int, length: int) -> dict:
        """Rows ``start`` and on of the listing, ``length`` at most, oldest first."""
        day = self.options.get("from")
        form = {"submitted_start_date": f"{day} 00:00:00" if day else "", "submitted_end_date": "", "order[0][dir]": "asc", "draw": "1", "start": str(start), "length": str(length)}
        client = self.client()
        found = json.loads(client.request(self.options["search"], form, {"X-CSRFToken": client.cookie("csrftoken") or ""})[2].decode("utf-8", "replace"))
        if found.get("data") is None:
            raise ValueError(f"listing without data: {str(found)[:500]}")
        return found

    def length(self, known: int) -> int:
        """How many rows the listing has: as it says, or else by its pages from row ``known`` on."""
        size = int(self.options.get("page_rows", PAGE_ROWS))
        found = self.listing(known, size)
        if "recordsFiltered" in found:
            return int(found["recordsFiltered"])
        while len(found["data"]) == size:
            known += size
            found = self.listing(known, size)
        return known + len(found["data"])

    def archive(self, year: int) -> bytes:
        return self.client().request(self.options["index"].replace("{year}", str(year)))[2]

    def years(self) -> list[int]:
        return list(range(int(self.options["first_year"]), int(self.options["last_year"]) + 1)) if self.options.get("index") else []

    def read(self, partition):
        chamber, what = partition.value
        if chamber == "senate":
            start, end = what
            size = int(self.options.get("page_rows", PAGE_ROWS))
            if end - start > size * int(self.options.get("most_pages", MOST_PAGES)):
                raise ValueError(f"listing has more than {self.options.get('most_pages', MOST_PAGES)} pages")
            for page, at in enumerate(range(start, end, size)):
                yield "senate", page, json.dumps({"data": self.listing(at, min(size, end - at))["data"]})
        else:
            for year in what:
                yield "house", year, json.dumps({"index": readers.index_rows(self.archive(year))})


class _Listings(_Chambers, DataSourceReader):
    def partitions(self):
        parts = [InputPartition(("senate", (0, self.length(0))))] if self.options.get("search") else []
        return parts + ([InputPartition(("house", self.years()))] if self.years() else [])


class _ListingStream(_Chambers, DataSourceStreamReader):
    def initialOffset(self):
        return {"senate": 0, "house": {}}

    def latestOffset(self):
        rows = self.length(0) if self.options.get("search") else 0
        return {"senate": rows, "house": {str(y): hashlib.sha256(self.archive(y)).hexdigest() for y in self.years()}}

    def partitions(self, start, end):
        parts = [InputPartition(("senate", (start["senate"], end["senate"])))] if end["senate"] > start["senate"] else []
        changed = [int(y) for y, digest in end["house"].items() if start["house"].get(y) != digest]
        return parts + ([InputPartition(("house", changed))] if changed else [])

    def commit(self, end):
        """Nothing to do: sites keep what they list."""


def listed_filings(listings: DataFrame, senate: str, house: str) -> DataFrame:
    """The filings (filings.FILING_COLUMNS, without texts) in payloads of chamber_listings; ``senate`` and ``house`` are the addresses that those of filings begin with."""
    none = F.lit(None).cast("string")
    found = filings.listing_rows(listings.filter("chamber = 'senate'"), senate).filter("error IS NULL")
    named = {"chamber": F.lit("senate"), "member": F.col("name"), "state": none, "district": none, "filing_date": F.col("filed_date"), "source_url": F.col("url"), "text": none, "html": none}
    rows = F.explode(F.from_json("payload", "index array<array<string>>")["index"]).alias("r")
    index = listings.filter("chamber = 'house'").select(rows).select(*(F.get("r", F.lit(k)).alias(c) for k, c in enumerate(readers.INDEX_COLUMNS)))
    more = {"chamber": F.lit("house"), "is_paper": F.lit(False), "text": none, "html": none}
    return found.withColumns(named).select(filings.FILING_COLUMNS).unionByName(filings.index_filings(index, house).withColumns(more).select(filings.FILING_COLUMNS))


def price_session(client: PoliteClient, cookie: str, crumb: str) -> str:
    """The crumb that a price site gives to a client with its cookie; an empty one where it gives none, and charts are asked without."""
    for url in (cookie, crumb):
        status, body, _, _ = answer(client, url)
    text = (body or b"").decode("utf-8", "replace").strip()
    return text if status is not None and 200 <= status < 300 and "<" not in text else ""


def price_charts(tickers: DataFrame, chart: str, cookie: str, crumb: str, **manners) -> DataFrame:
    """(ticker, body) of chart answers for readers.read_prices(), of the tickers whose answer is good; ``chart`` is an address with {symbol}.

    The cookie and the crumb are asked for once and kept for all charts; it is one host, so one task.
    """
    def run(batches):
        import pyarrow as pa

        client, key = _client(manners), None
        for batch in batches:
            names, bodies = [], []
            for ticker, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = price_session(client, cookie, crumb) if key is None else key
                url = chart.replace("{symbol}", quote(symbol, safe="-"))
                url += f"{'&' if '?' in url else '?'}crumb={quote(key, safe='')}" if key else ""
                status, body, _, _ = answer(client, url)
                if status == 200:
                    names.append(ticker), bodies.append(body.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string())], names=["ticker", "body"])

    asked = tickers.select("ticker", scalars.market_symbol("ticker").alias("symbol")).filter("symbol <> ''").distinct()
    return asked.coalesce(1).mapInArrow(run, "ticker string, body string")


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    for source in (ListingSource, FetchSource, ChamberListings):
        spark.dataSource.register(source)
