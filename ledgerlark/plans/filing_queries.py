"""Queries of filings, rosters and the published dataset, on inputs that expressions make from the driver's tables.

A customer stands for a filing and its orders for the filing's rows, so each query's SQL can say
from the orders what the parsers must find again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import scalars
from ledgerlark.operators import contracts, filings, joins, returns, schemas, trigrams, upserts, views
from ledgerlark.operators.scratch import owned, saved
from ledgerlark.plans.pdf_files import pdf_files
from ledgerlark.plans.registry import TRADES, query, table, trades
from ledgerlark.sources import html_tables, pdf, readers, sinks
from ledgerlark.streaming import incremental, versions

#: The rows of all filings as SQL and, below, as a DataFrame.
ROWS = """
    SELECT o_custkey AS f, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place,
           CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE 'T' || CAST(o_orderkey % 97 AS VARCHAR) END AS ticker,
           CASE o_orderkey % 4 WHEN 1 THEN 'SP' WHEN 2 THEN 'JT' WHEN 3 THEN 'DC' END AS owner,
           CASE o_orderstatus WHEN 'F' THEN 'buy' WHEN 'O' THEN 'sell' ELSE 'exchange' END AS type, o_orderstatus = 'O' AND o_orderkey % 3 = 0 AS partial,
           CAST(o_orderdate AS DATE) AS tx_date, CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT) + 1 AS lo, CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT) + 15000 AS hi
    FROM orders
"""


def filing_rows(spark, sf_dir: str) -> DataFrame:
    """(f, k, place, ticker, owner, type, partial, tx_date, lo, hi) of ROWS."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    floor = (F.floor(F.col("o_totalprice") / 1000) * 1000).cast("long")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("f"), k.alias("k"), place.alias("place"),
        F.when(k % 5 != 4, F.concat(F.lit("T"), (k % 97).cast("string"))).alias("ticker"),
        F.when(k % 4 == 1, "SP").when(k % 4 == 2, "JT").when(k % 4 == 3, "DC").alias("owner"),
        F.when(status == "F", "buy").when(status == "O", "sell").otherwise("exchange").alias("type"),
        ((status == "O") & (k % 3 == 0)).alias("partial"),
        F.col("o_orderdate").cast("date").alias("tx_date"), (floor + 1).alias("lo"), (floor + 15_000).alias("hi"),
    )


def _filed(spark, sf_dir: str) -> DataFrame:
    """What filings have besides their rows: one for each customer."""
    none = F.lit(None).cast("string")
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("f"), F.concat(F.lit("f"), key.cast("string")).alias("filing_id"), F.col("c_name").alias("member"), none.alias("state"), none.alias("district"), F.lit("2001-12-31").cast("date").alias("filing_date"), F.concat(F.lit("https://x/"), key.cast("string")).alias("source_url"))


def _joined(rows: DataFrame, line, name: str, between: str = "\n") -> DataFrame:
    """(f, ``name``) with the lines of each filing in order of its rows."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("f").agg(F.array_join(lines, between).alias(name))


def text_filings(spark, sf_dir: str) -> DataFrame:
    """Filings as text: rows on one line, or with the amount or the ticker wrapped, with metadata and boilerplate between; one in fifty has a row without an amount."""
    rows, k = filing_rows(spark, sf_dir), F.col("k")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind = F.when(F.col("type") == "buy", "P").when(F.col("type") == "exchange", "E").when(F.col("partial"), "S (partial)").otherwise("S")
    day = scalars.us_date("tx_date")
    money = lambda c: F.format_number(c, 0)
    head = say(F.coalesce(say(F.col("owner"), " "), F.lit("")), "Nova ", k.cast("string"), " Corp")
    tail = say(" ", kind, " ", day, " ", day, " $", money("lo"), " -")
    whole = say(tail, " $", money("hi"))
    mark = say(" (", F.col("ticker"), ") [ST]")
    line = (
        F.when(k % 5 == 0, say(head, mark, whole))
        .when(k % 5 == 1, say(head, tail, "\n", mark, " $", money("hi"), "\nF S: New"))
        .when(k % 5 == 2, say(head, whole, "\n", mark, "\nD: a note\nwords that follow the note"))
        .when(k % 5 == 3, say("* For the complete list of codes\n", head, mark, whole, "\r\nPage 3 of 9"))
        .otherwise(say(head, " [GS]", whole))
    )
    texts = _filed(spark, sf_dir).join(_joined(rows, line, "body"), "f", "left")
    bad = F.when(F.col("f") % 50 == 7, "\nOdd Corp P 05/04/2001 05/05/2001 None").otherwise("")
    return texts.withColumn("text", say("Filing ID #1\nName: Somebody\n", F.coalesce("body", F.lit("")), bad)).drop("body")


def page_filings(spark, sf_dir: str) -> DataFrame:
    """Filings as HTML pages, with a menu in a table before that of the trades."""
    rows = filing_rows(spark, sf_dir)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    owner = F.coalesce(scalars.literal_map({"SP": "Spouse", "JT": " Joint ", "DC": "Dependent Child"})[F.col("owner")], F.lit("Self"))
    kind = F.when(F.col("type") == "buy", "Purchase").when(F.col("type") == "exchange", "Exchange").when(F.col("partial"), "Sale (Partial)").otherwise("Sale  (Full)")
    cells = [(F.col("place") + 1).cast("string"), scalars.us_date("tx_date"), owner, F.coalesce(say("<a href='#'>", F.col("ticker"), "</a>"), F.lit("--")), say("Nova ", F.col("k").cast("string"), " &amp;\n Sons"), F.lit("Stock"), kind, say("$", F.format_number("lo", 0), " - $", F.format_number("hi", 0))]
    line = say("<tr>", *(say("<td>", c, "</td>") for c in cells), "</tr>")
    heads = "".join(f"<th>{h}</th>" for h in ("#", "Transaction Date", "Owner", "Ticker", "Asset Name", "Asset Type", "Type", "Amount"))
    pages = _filed(spark, sf_dir).join(_joined(rows, line, "body"), "f", "left")
    return pages.withColumn("html", say(f"<table><tr><td>menu</td></tr></table><p><table><tr>{heads}</tr>", F.coalesce("body", F.lit("")), "<tr><td>Total</td></tr></table>")).drop("body")


FOUND = ("id", "filing_id", "ticker", "asset", "asset_type", "type", "partial", "owner", "tx_date", "amount_lo", "amount_hi", "amount_label")


def _found(rows: DataFrame) -> DataFrame:
    """The trades' columns, null in rows that tell of an error."""
    return rows.select("filing_id", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in FOUND if c != "filing_id"), "error")


def _expected(chamber: str, asset: str, asset_type: str, bad: str) -> str:
    return f"""
    WITH r AS ({ROWS}), n AS (SELECT f, count(*) AS n FROM r GROUP BY f),
         e AS (SELECT c_custkey AS f, CASE WHEN {bad} THEN 'unreadable row' WHEN n IS NULL THEN 'no transaction rows' END AS error FROM customer LEFT JOIN n ON f = c_custkey)
    SELECT 'f' || CAST(f AS VARCHAR) AS filing_id, '{chamber}:f' || CAST(f AS VARCHAR) || ':' || CAST(place AS VARCHAR) AS id, ticker, {asset} AS asset, {asset_type} AS asset_type, type, partial, owner, tx_date,
           lo AS amount_lo, hi AS amount_hi, '$' || format('{{:,}}', lo) || ' - $' || format('{{:,}}', hi) AS amount_label, CAST(NULL AS VARCHAR) AS error
    FROM r JOIN e USING (f) WHERE error IS NULL
    UNION ALL SELECT 'f' || CAST(f AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL
    """


@query(_expected("house", "'Nova ' || CAST(k AS VARCHAR) || ' Corp'", "CASE WHEN k % 5 = 4 THEN 'Government Security' ELSE 'Stock' END", "c_custkey % 50 = 7"))
def text_trades(spark, sf_dir):
    """Trades of text filings, and the errors of those that can't be read."""
    return _found(filings.text_trades(text_filings(spark, sf_dir)))


@query(_expected("house", "'Nova ' || CAST(k AS VARCHAR) || ' Corp'", "CASE WHEN k % 5 = 4 THEN 'Government Security' ELSE 'Stock' END", "c_custkey % 50 = 7"))
def pdf_trades(spark, sf_dir):
    """Trades of the text filings as PDF files: words set one by one, put together again by their places on the pages."""
    texts = text_filings(spark, sf_dir)
    files = pdf_files(texts.select(F.col("filing_id").alias("path"), F.concat("text", F.lit("\nDigitally signed by nobody in particular, on paper")).alias("text")))
    read = saved(texts.drop("text").join(pdf.pdf_texts(files).withColumnRenamed("path", "filing_id").drop("error"), "filing_id"), "pdf-texts")  # files are read once
    return _found(filings.text_trades(read))


@query(
    f"""
    WITH r AS ({ROWS}) SELECT 'f' || CAST(f AS VARCHAR) AS path, CAST(1 + place // 40 AS INTEGER) AS page, place % 40 AS line,
           'row ' || CAST(k AS VARCHAR) || '|' || coalesce(ticker, '--') || '|' || type || '|$' || CAST(lo AS VARCHAR) AS cells FROM r
    """
)
def pdf_cells(spark, sf_dir):
    """The cells of tables in PDF files, told by the gaps between them."""
    part = lambda c, n: F.rpad(c, n, " ")
    row = F.concat(part(F.concat(F.lit("row "), F.col("k").cast("string")), 20), part(F.coalesce("ticker", F.lit("--")), 12), part(F.col("type"), 14), F.lit("$"), F.col("lo").cast("string"))
    texts = _joined(filing_rows(spark, sf_dir), row, "text").select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("path"), "text")
    lines = pdf.file_lines(pdf_files(texts))
    return lines.select("path", "page", "line", F.array_join("cells", "|").alias("cells"))


@query(_expected("senate", "'Nova ' || CAST(k AS VARCHAR) || ' & Sons'", "'Stock'", "false"))
def table_trades(spark, sf_dir):
    """Trades of filings that are HTML pages."""
    pages = page_filings(spark, sf_dir)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: pages are small, parsing them isn't
    return _found(filings.table_trades(pages, html_tables.html_rows(pages.repartition(parts, "f"), "filing_id")))


@query(
    """
    SELECT CASE WHEN c_custkey % 19 = 4 THEN NULL ELSE 'id-' || CAST(c_custkey AS VARCHAR) END AS filing_id, c_mktsegment || ' ' || c_name AS name,
           CASE WHEN c_custkey % 17 = 5 THEN NULL ELSE DATE '2001-01-01' + CAST(c_custkey % 300 AS INT) END AS filed_date,
           CASE WHEN c_custkey % 19 = 4 THEN NULL ELSE 'https://h/search/view/' || CASE WHEN c_custkey % 10 = 3 THEN 'paper' ELSE 'ptr' END || '/id-' || CAST(c_custkey AS VARCHAR) || '/' END AS url,
           CASE WHEN c_custkey % 19 = 4 THEN NULL ELSE c_custkey % 10 = 3 END AS is_paper, CASE WHEN c_custkey % 19 = 4 THEN NULL ELSE 'Report for ' || CAST(c_custkey AS VARCHAR) END AS title,
           CASE WHEN c_custkey % 19 = 4 THEN 'no report link' WHEN c_custkey % 17 = 5 THEN 'no filed date' END AS error
    FROM customer
    """
)
def listing_rows(spark, sf_dir):
    """Customers as the rows of listing pages of a hundred each, read back."""
    key = F.col("c_custkey")
    text = key.cast("string")
    link = F.concat(F.lit("<a href='/search/view/"), F.when(key % 10 == 3, "paper").otherwise("ptr"), F.lit("/id-"), text, F.lit("/' target=_blank>Report\n for  "), text, F.lit("</a>"))
    day = F.concat(F.lit(" "), scalars.us_date(F.date_add(F.lit("2001-01-01").cast("date"), (key % 300).cast("int"))), F.lit(" "))
    cells = F.array(F.col("c_mktsegment"), F.concat(F.lit(" "), F.col("c_name")), F.lit("office"), F.when(key % 19 == 4, "none").otherwise(link), F.when(key % 17 == 5, "soon").otherwise(day))
    pages = table(spark, sf_dir, "customer").groupBy(F.floor(key / 100)).agg(F.to_json(F.struct(F.collect_list(cells).alias("data"))).alias("payload"))
    found = filings.listing_rows(pages, "https://h")
    linked = F.col("url").isNotNull() & ~(F.col("error") == "no report link").eqNullSafe(True)
    return found.select(F.when(linked, F.col("filing_id")).alias("filing_id"), "name", "filed_date", F.when(linked, F.col("url")).alias("url"), F.when(linked, F.col("is_paper")).alias("is_paper"), F.when(linked, F.col("title")).alias("title"), "error")


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS filing_id, c_mktsegment || ' ' || c_name AS member, CASE WHEN c_custkey % 7 <> 1 THEN 'TX' END AS state, CASE WHEN c_custkey % 7 <> 1 THEN 'TX-' || CAST(c_custkey % 40 AS VARCHAR) END AS district,
           DATE '2001-01-01' + CAST(c_custkey % 300 AS INT) AS filing_date, 'https://p/2001/' || CAST(c_custkey AS VARCHAR) || '.pdf' AS source_url
    FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 11 <> 2
    """
)
def index_filings(spark, sf_dir):
    """Customers as a yearly index: two of three are of another filing type, some lack a document."""
    key = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (key % 300).cast("int")), "M/d/yyyy")
    place = F.when(key % 7 != 1, F.format_string("TX%02d", key % 40)).otherwise("T1")
    values = ("Hon.", F.concat("c_name", F.lit(" ")), "c_mktsegment", "", F.when(key % 3 == 0, " P").otherwise("X"), place, "2001", day, F.when(key % 11 == 2, " ").otherwise(key.cast("string")))
    columns = [F.lit(v) if isinstance(v, str) and not v.startswith("c_") else F.col(v) if isinstance(v, str) else v for v in values]
    index = table(spark, sf_dir, "customer").select(*(c.alias(n) for c, n in zip(columns, readers.INDEX_COLUMNS, strict=True)))
    return filings.index_filings(index, "https://p")


MEMBERS = """SELECT r_name || ' Q. ' || n_name AS name, CASE WHEN r_regionkey < 2 THEN 'house' END AS chamber, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'P' || CAST(n_nationkey % 3 AS VARCHAR) END AS party, r_name AS state,
             CASE WHEN n_nationkey % 2 = 0 THEN r_name || '-' || CAST(n_nationkey AS VARCHAR) END AS district, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"""


def members(spark, sf_dir: str) -> DataFrame:
    """A roster of nations, as MEMBERS has it."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    return nation.select(
        F.concat_ws(" ", "r_name", F.lit("Q."), "n_name").alias("name"), F.when(F.col("r_regionkey") < 2, "house").alias("chamber"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("P"), (key % 3).cast("string"))).alias("party"), F.col("r_name").alias("state"),
        F.when(key % 2 == 0, F.concat("r_name", F.lit("-"), key.cast("string"))).alias("district"), F.lit(None).cast("array<string>").alias("aliases"), key.alias("position"),
    )


@query(
    f"""
    WITH m AS ({MEMBERS}), c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber FROM customer),
         x AS (SELECT c.*, m.name, m.party, m.state, m.district FROM c LEFT JOIN m ON n_nationkey = c_nationkey AND c_nationkey % 3 <> 2 AND (m.chamber IS NULL OR m.chamber = c.chamber)),
         raw AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Hon. ' || r_name || '  Q. ' || n_name || ', Jr.' WHEN 1 THEN upper(n_name) || ', ' || lower(r_name) ELSE 'Nobody Known' END AS raw FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, coalesce(name, raw) AS member, coalesce(nullif(party, ''), 'old') AS party, state, district FROM x JOIN raw ON n_nationkey = c_nationkey
    """
)
def enriched_trades(spark, sf_dir):
    """Customers' made-up names as members of trades, enriched from a roster of nations; what the roster lacks stays."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("n_nationkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("Hon. "), F.col("r_name"), F.lit("  Q. "), F.col("n_name"), F.lit(", Jr."))).when(kind == 1, F.concat(F.upper("n_name"), F.lit(", "), F.lower("r_name"))).otherwise("Nobody Known")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", raw.alias("member"), F.when(F.col("c_custkey") % 2 == 0, "house").otherwise("senate").alias("chamber"), F.lit("old").alias("party"), none.alias("state"), none.alias("district"))
    return joins.enrich(rows, members(spark, sf_dir)).drop("chamber")


PRICED = """
    prices AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) / 7 AS c FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 2 = 0 GROUP BY ALL),
    buys AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Brand#' || CAST(o_orderkey % 40 AS VARCHAR) END AS ticker, CAST(o_orderdate AS DATE) AS tx_date FROM orders WHERE o_orderstatus = 'F'),
    latest AS (SELECT ticker, max(d) AS asof_date, arg_max(c, d) AS close FROM prices GROUP BY 1),
    priced AS (SELECT id, buys.ticker AS ticker, close, asof_date FROM buys ASOF JOIN prices ON buys.ticker = prices.ticker AND buys.tx_date >= prices.d JOIN latest ON latest.ticker = buys.ticker WHERE prices.c > 0)
"""


def _buys(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Buys and prices of PRICED."""
    items = table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    prices = items.groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("day")).agg((F.max("l_extendedprice") / 7).alias("close"))
    k = F.col("o_orderkey")
    bought = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Brand#"), (k % 40).cast("string"))).alias("ticker"), F.col("o_orderdate").cast("date").alias("tx_date"), F.when(F.col("o_orderstatus") == "F", "buy").otherwise("sell").alias("type"))
    return bought, prices


@query(f"WITH {PRICED} SELECT (SELECT count(*) FROM buys WHERE ticker <> '') AS total_buys, count(DISTINCT id) AS priced_buys, count(DISTINCT ticker) AS tickers FROM priced")
def coverage(spark, sf_dir):
    """How many buys there are, and how many of them and of their tickers are priced."""
    bought, prices = _buys(spark, sf_dir)
    return returns.coverage(bought, returns.buy_returns(bought, prices))


@query(f"WITH {PRICED} SELECT ticker, any_value(asof_date) AS asof_date, CAST(format('{{:.4f}}', any_value(close)) AS DOUBLE) AS asof_close FROM priced GROUP BY ticker")
def ticker_prices(spark, sf_dir):
    """The last close of each ticker with a priced buy."""
    return returns.ticker_prices(returns.buy_returns(*_buys(spark, sf_dir)))


@query("SELECT DISTINCT 'Brand#' || CAST(o_orderkey % 40 AS VARCHAR) AS ticker FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 13 <> 0 ORDER BY ticker LIMIT 12")
def capped_tickers(spark, sf_dir):
    """The first dozen tickers of buys."""
    return returns.buy_tickers(_buys(spark, sf_dir)[0], 12)


@query(
    """
    SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS day, arg_max(l_extendedprice / 3, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS close
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY ALL
    """
)
def chart_prices(spark, sf_dir):
    """Prices read from chart answers: one answer for each brand, whose adjusted closes are missing for returned items."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    point = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", F.unix_timestamp("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / 3).alias("close"))
    series = items.groupBy(F.col("p_brand").alias("ticker")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    of = lambda name: F.transform("points", lambda p: p[name])
    raw = F.array(F.struct(F.transform("points", lambda p: F.lit(1.0)).alias("close")))
    answer = F.struct(of("ts").alias("timestamp"), F.struct(raw.alias("quote"), F.array(F.struct(of("close").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    bodies = series.select("ticker", F.to_json(F.struct(F.struct(F.array(answer).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("body"))
    return readers.read_prices(bodies)


@query(
    f"""
    WITH t AS ({TRADES}), c AS (SELECT c_name AS member, c_custkey FROM customer WHERE c_custkey % 5 = 0)
    SELECT c.member AS member, count(*) FILTER (tx_date >= DATE '2001-01-01') AS n, count(*) FILTER (tx_date >= DATE '2001-01-01' AND type = 'buy') AS buys, count(*) FILTER (tx_date >= DATE '2001-01-01' AND type = 'sell') AS sells,
           arg_min(ticker, id) AS latest_ticker, arg_min(tx_date, id) AS latest_date, any_value(c_custkey % 3) AS paper
    FROM c LEFT JOIN t ON t.member = c.member GROUP BY c.member
    """
)
def featured_cards(spark, sf_dir):
    """Every fifth customer as a featured member, with paper filings for some."""
    customer = table(spark, sf_dir, "customer")
    featured = customer.filter("c_custkey % 5 = 0").select(F.col("c_name").alias("member"))
    skipped = customer.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter("copy < c_custkey % 3").select(F.col("c_name").alias("member"), F.lit("paper").alias("reason"))
    errors = customer.select(F.col("c_name").alias("member"), F.lit("parse_error").alias("reason"))
    cards = views.featured_cards(trades(spark, sf_dir), skipped.union(errors), featured, "2001-04-01", 90, "id")
    return cards.select("member", "n", "buys", "sells", F.col("latest.ticker").alias("latest_ticker"), F.col("latest.tx_date").alias("latest_date"), "paper")


@query(
    """
    SELECT name, array_to_string(list_sort(list_distinct(list_filter(aliases, lambda a: a <> name))), '|') AS aliases, party FROM (
      SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN ['old ' || c_mktsegment, 'both', 'new'] ELSE ['new', 'both'] END AS aliases, 'new' AS party FROM customer WHERE c_custkey % 3 <> 0
      UNION ALL SELECT c_name, ['both', 'old ' || c_mktsegment], 'old' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0)
    """
)
def merged_roster(spark, sf_dir):
    """A roster of every second customer merged into one of two of three."""
    customer = table(spark, sf_dir, "customer")
    old = customer.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.array(F.lit("both"), F.concat(F.lit("old "), "c_mktsegment")).alias("aliases"), F.lit("old").alias("party"))
    new = customer.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.array(F.lit("new"), F.col("c_name"), F.lit("both")).alias("aliases"), F.lit("new").alias("party"))
    return upserts.merge_rosters(old, new).select("name", F.array_join(F.array_sort("aliases"), "|").alias("aliases"), "party")


@query(
    """
    WITH c AS (SELECT *, 'First' || CAST(c_custkey AS VARCHAR) AS f, c_mktsegment AS l, CASE WHEN c_custkey % 2 = 0 THEN 'Mid' END AS m, CASE WHEN c_custkey % 3 = 0 THEN 'Nick' END AS k FROM customer),
         n AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN f || ' ' || l ELSE c_name END AS name FROM c)
    SELECT name, CASE WHEN c_custkey % 4 = 0 THEN 'senate' ELSE 'house' END AS chamber, CASE c_custkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'Other' END AS party, 'TX' AS state,
           CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 THEN 'TX-' || CAST(c_custkey % 9 AS VARCHAR) END AS district,
           array_to_string(list_sort(list_filter(list_distinct([l || ', ' || f, f || ' ' || l, f || ' ' || m || ' ' || l, m || ' ' || l, k || ' ' || l, l || ', ' || k, k || ' ' || m || ' ' || l]), lambda a: a IS NOT NULL AND a <> name)), '|') AS aliases
    FROM n
    """
)
def built_roster(spark, sf_dir):
    """A roster from customers in the form of legislators' records: the last of two terms counts."""
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    name = F.struct(F.concat(F.lit("First"), key.cast("string")).alias("first"), F.when(key % 2 == 0, "Mid").alias("middle"), F.col("c_mktsegment").alias("last"), F.when(key % 5 != 0, F.col("c_name")).alias("official_full"), F.when(key % 3 == 0, "Nick").otherwise(none).alias("nickname"))
    term = lambda kind, party, district: F.struct(kind.alias("type"), F.lit("TX").alias("state"), district.cast("int").alias("district"), party.alias("party"))
    last = term(F.when(key % 4 == 0, "sen").otherwise("rep"), F.when(key % 3 == 0, "Democrat").when(key % 3 == 1, "Republican").otherwise("Other"), F.when(key % 7 != 0, key % 9))
    records = table(spark, sf_dir, "customer").select(name.alias("name"), F.array(term(F.lit("sen"), F.lit("Independent"), F.lit(1)), last).alias("terms"))
    return readers.build_roster(records).withColumn("aliases", F.array_join("aliases", "|"))


@query(
    """
    SELECT env, n, expected, (n > 0) = expected AS holds FROM (
      SELECT event_type AS env, CAST(count(*) FILTER (value > 99) AS BIGINT) AS n, event_type IN ('click', 'error') AS expected FROM events GROUP BY 1)
    """
)
def rollout(spark, sf_dir):
    """Kinds of events as environments, large values as probes that were seen."""
    probes = table(spark, sf_dir, "events").select(F.col("event_type").alias("env"), (F.col("value") > 99).alias("seen"))
    kinds = [r[0] for r in probes.select("env").distinct().collect()]  # the rule of each environment is a parameter
    return contracts.rollout(probes, {k: k in ("click", "error") for k in kinds})


@query(
    """
    WITH p AS (SELECT user_id AS page, count(*) FILTER (event_type = 'error' AND value < 5) AS errors, count(*) FILTER (event_type <> 'error' AND value > 50) AS failures FROM events GROUP BY 1)
    SELECT CAST(count(*) FILTER (errors = 0 AND failures = 0) AS BIGINT) AS healthy, CAST(count(*) FILTER (errors > 0 OR failures > 0) AS BIGINT) AS unhealthy, count(*) FILTER (errors > 0 OR failures > 0) = 0 AS all_pass FROM p
    """
)
def health_gate(spark, sf_dir):
    """Users as pages, some of their events as errors and failures: how many are healthy."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "page")
    pages = events.select("page").distinct()
    return contracts.health_gate(contracts.page_health(pages, events.filter("event_type = 'error' AND value < 5"), events.filter("event_type <> 'error' AND value > 50")))


@query(
    """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'blocked' WHEN event_type = 'error' THEN 'unreachable' ELSE 'reachable' END AS outcome, event_id % 5 <> 0 AND event_type <> 'error' AS ok FROM events
    """
)
def reachability(spark, sf_dir):
    """Events as probes: every fifth is denied, errors are those that failed."""
    probes = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "deny").alias("deny"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return contracts.reachability(probes).select("event_id", "outcome", "ok")


@query("SELECT count(*) AS n, false AS changed_by_order, true AS changed_by_value, true AS changed_by_repeat FROM orders")
def content_change(spark, sf_dir):
    """Whether a table counts as changed when its rows are only reordered, when one value differs, and when a row is repeated."""
    orders = table(spark, sf_dir, "orders")
    other = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    turned = orders.repartition(5, "o_custkey")
    flags = (upserts.changed(orders, turned), upserts.changed(orders, other), upserts.changed(orders, orders.union(orders.filter("o_orderkey = 0"))))
    return upserts.content_digest(orders).select("n", *(F.lit(f).alias(c) for f, c in zip(flags, ("changed_by_order", "changed_by_value", "changed_by_repeat"), strict=True)))


@query(f"WITH t AS ({TRADES}) SELECT id, ticker, member, tx_date FROM t WHERE ticker = 'NATION_3' AND tx_date >= DATE '2000-01-01'")
def ticker_trades(spark, sf_dir):
    """The trades of one ticker since a day."""
    return views.ticker_trades(trades(spark, sf_dir), "NATION_3", "2000-01-01").select("id", "ticker", "member", "tx_date")


@query(
    f"""
    WITH t AS ({TRADES}), x AS (SELECT *, type = 'sell' AND id % 2 = 0 AS partial, CASE id % 3 WHEN 0 THEN 'D' WHEN 1 THEN '' END AS party, CASE WHEN id % 4 = 0 THEN 'TX-' || CAST(id % 9 AS VARCHAR) END AS district,
           CASE WHEN id % 7 = 0 THEN 'Option' ELSE 'Stock' END AS asset_type, (id % 101 - 50) / CAST(2 AS DOUBLE) AS pct FROM t)
    SELECT id, CASE WHEN partial THEN 'sell (partial)' ELSE type END AS type_text, member AS member_text, concat_ws(' · ', nullif(party, ''), coalesce(district, 'TX')) AS member_chip,
           CASE WHEN type = 'buy' AND asset_type = 'Stock' AND id % 5 <> 0 THEN CASE WHEN pct >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', pct) || '%' ELSE '—' END AS return_text,
           CASE WHEN type = 'buy' AND asset_type = 'Stock' AND id % 5 <> 0 THEN CASE WHEN pct >= 0 THEN 'up' ELSE 'down' END || ' since $' || CAST(id % 50 + 0.5 AS VARCHAR) || ' on ' || CAST(tx_date AS VARCHAR)
                || CASE WHEN ticker <> 'NATION_1' THEN ', now $9.25 on 2001-08-01' ELSE '' END END AS return_tip
    FROM x
    """
)
def display_columns(spark, sf_dir):
    """What a table of trades shows of types, members and returns."""
    k = F.col("id")
    rows = trades(spark, sf_dir).withColumns({
        "partial": (F.col("type") == "sell") & (k % 2 == 0), "party": F.when(k % 3 == 0, "D").when(k % 3 == 1, ""), "state": F.lit("TX"),
        "district": F.when(k % 4 == 0, F.concat(F.lit("TX-"), (k % 9).cast("string"))), "asset_type": F.when(k % 7 == 0, "Option").otherwise("Stock"),
    })
    gains = rows.filter("id % 5 <> 0").select("id", F.col("tx_date").alias("entry_date"), (k % 50 + 0.5).cast("double").alias("entry_close"), ((k % 101 - 50) / 2).alias("pct"))
    prices = table(spark, sf_dir, "nation").filter("n_name <> 'NATION_1'").select(F.col("n_name").alias("ticker"), F.lit("2001-08-01").cast("date").alias("asof_date"), F.lit(9.25).alias("asof_close"))
    return views.display(rows, gains, prices)


@query(
    f"""
    WITH t AS ({TRADES}), s AS (SELECT c_custkey, c_name, DATE '2001-01-01' + CAST(c_custkey % 7 AS INT) AS day, 'f' || CAST(c_custkey AS VARCHAR) AS fid FROM customer),
         a AS (SELECT 3 AS section, row_number() OVER (ORDER BY tx_date DESC, member, id) - 1 AS pos, count(*) OVER () AS n, to_json({{'id': id, 'member': member, 'ticker': ticker, 'type': type, 'tx_date': tx_date, 'filing_date': tx_date, 'amount_hi': amount_hi}}) AS j FROM t
               UNION ALL SELECT 5, row_number() OVER (ORDER BY day DESC, fid DESC) - 1, count(*) OVER (), to_json({{'filing_id': fid, 'member': c_name, 'filing_date': day}}) FROM s)
    SELECT CAST(section AS INT) AS section, pos, '  ' || CAST(j AS VARCHAR) || CASE WHEN pos < n - 1 THEN ',' ELSE '' END AS line FROM a
    """
)
def document_lines(spark, sf_dir):
    """The lines of the published document that hold trades and skipped filings, in their order."""
    rows = trades(spark, sf_dir).withColumn("filing_date", F.col("tx_date")).select("id", "member", "ticker", "type", "tx_date", "filing_date", "amount_hi")
    key = F.col("c_custkey")
    skipped = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), key.cast("string")).alias("filing_id"), F.col("c_name").alias("member"), F.date_add(F.lit("2001-01-01").cast("date"), (key % 7).cast("int")).alias("filing_date"))
    meta = spark.range(1).select(F.lit("2001-08-01.1").alias("data_version"))
    return sinks.document_lines(rows, skipped, meta).filter("section IN (3, 5)")


def _as_filings(spark, sf_dir: str) -> DataFrame:
    """Text filings of the house with all that a run reads: one in ten is paper, one in six is older than the window."""
    f = F.col("f")
    rows = text_filings(spark, sf_dir).withColumns({"chamber": F.lit("house"), "is_paper": f % 10 == 3, "listed": f})
    return rows.withColumn("filing_date", F.when(f % 6 == 0, F.lit("1999-12-31")).otherwise("2001-07-01").cast("date")).drop("f")


OLD = "c_custkey % 6 = 0"


@query(f"SELECT 'house' AS chamber, 'f' || CAST(c_custkey AS VARCHAR) AS filing_id, c_name AS member, DATE '2001-07-01' AS filing_date FROM customer WHERE NOT {OLD}")
def planned_run(spark, sf_dir):
    """What a run over all filings would fetch into an empty dataset."""
    data = incremental.Dataset(spark, owned(spark, "dataset"))
    return incremental.planned(data, _as_filings(spark, sf_dir), "2001-08-01")


@query(
    f"""
    WITH r AS ({ROWS}), n AS (SELECT f, count(*) AS n FROM r GROUP BY f),
         s AS (SELECT c_custkey AS f, c_name, CASE WHEN c_custkey % 10 = 3 THEN 'paper' WHEN c_custkey % 50 = 7 OR n IS NULL THEN 'parse_error' ELSE 'read' END AS state FROM customer LEFT JOIN n ON f = c_custkey WHERE NOT {OLD})
    SELECT state AS what, 'f' || CAST(f AS VARCHAR) AS filing_id, CAST(NULL AS VARCHAR) AS id, c_name AS member, CAST(NULL AS BIGINT) AS amount_lo FROM s WHERE state <> 'read'
    UNION ALL SELECT 'trade', 'f' || CAST(f AS VARCHAR), 'house:f' || CAST(f AS VARCHAR) || ':' || CAST(place AS VARCHAR), c_name, lo FROM r JOIN s USING (f) WHERE state = 'read'
    UNION ALL SELECT 'processed ' || CAST(count(*) AS VARCHAR), NULL, NULL, NULL, NULL FROM s WHERE state <> 'parse_error'
    """
)
def incremental_run(spark, sf_dir):
    """A dataset after two runs over all filings, of which the second finds only what failed: its trades, skipped filings and number of processed ones."""
    data = incremental.Dataset(spark, owned(spark, "dataset"))
    rows = saved(_as_filings(spark, sf_dir), "filings")  # both runs read them
    for _ in range(2):
        incremental.run(data, rows, filings.text_trades, members(spark, sf_dir), "2001-08-01", "2001-08-01T00:00:00Z")
    none = lambda kind: F.lit(None).cast(kind)
    found = data.read("trades").select(F.lit("trade").alias("what"), "filing_id", "id", "member", "amount_lo")
    skipped = data.read("skipped_filings").select("reason", "filing_id", none("string"), "member", none("long"))
    processed = incremental.processed_by_chamber(data.read("processed")).select(F.concat(F.lit("processed "), F.col("n").cast("string")), *[none("string")] * 3, none("long"))
    return found.union(skipped).union(processed)


@query(
    """
    SELECT c_custkey, strftime(DATE '2001-01-01' + CAST(c_custkey % 300 AS INT), '%m/%d/%Y') AS us_date, 'a ' || c_name AS snippet, '&lt;b&gt; &amp; &quot;' || c_name || '&#39;' AS escaped,
           CASE c_custkey % 4 WHEN 0 THEN 'SP' WHEN 1 THEN 'Trust' WHEN 2 THEN NULL ELSE 'DC' END AS owner, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'A' || CAST(c_custkey AS VARCHAR) END AS ticker, 'A' || CAST(c_custkey AS VARCHAR) || '-B' AS symbol,
           CASE c_custkey % 3 WHEN 0 THEN 'sell' WHEN 1 THEN 'buy' END AS kind, DATE '2001-01-01' + CAST(c_custkey % 300 AS INT) AS day, c_name || ' Inc' AS company,
           CASE WHEN c_custkey % 2 = 0 THEN 'http://x/' ELSE 'https://b/x/' END || CAST(c_custkey AS VARCHAR) AS url, CAST(floor(100.0 * (c_custkey % 7) / greatest(c_custkey % 7 + c_custkey % 5, 1) + 0.5) AS BIGINT) AS buy_share,
           format('{:.1f}%', (c_custkey % 8) / 8.0 * 100) AS percent, CASE WHEN c_custkey % 900 >= 10 THEN '$' || CAST(c_custkey % 900 AS VARCHAR) || 'k' ELSE '$' || CAST(c_custkey % 900 * 100 AS VARCHAR) END AS money,
           CASE WHEN (c_custkey % 10) / 100.0 <= 0.07 THEN 'OK (aligned)' ELSE 'REVIEW calibration (>7 pts)' END AS flag
    FROM customer
    """
)
def scalar_texts(spark, sf_dir):
    """The text functions over customers."""
    from ledgerlark.operators.probability import divergence_flag

    key = F.col("c_custkey")
    text = key.cast("string")
    day = F.date_add(F.lit("2001-01-01").cast("date"), (key % 300).cast("int"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.us_date(day).alias("us_date"), scalars.snippet(say(" a \t\n", name, "  ")).alias("snippet"), scalars.html_escape(say('<b> & "', name, "'")).alias("escaped"),
        scalars.owner_code(F.when(key % 4 == 0, " SPOUSE").when(key % 4 == 1, "Trust").when(key % 4 == 2, "self").otherwise("Dependent Child")).alias("owner"),
        scalars.clean_ticker(F.when(key % 3 == 0, " -- ").otherwise(say("- A", text, " -"))).alias("ticker"), scalars.market_symbol(say(" a", text, "./b ")).alias("symbol"),
        scalars.parse_tx_type(F.when(key % 3 == 0, "Sale  (Full).").when(key % 3 == 1, " p ").otherwise("gift"))["type"].alias("kind"), scalars.parse_date(F.when(key % 2 == 0, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "yyyy-M-d"))).alias("day"),
        scalars.company_name(say(name, "  Inc - Class A Common Stock $200?")).alias("company"), scalars.absolute_url(F.when(key % 2 == 0, say("http://x/", text)).otherwise(say("/x/", text)), "https://b").alias("url"),
        scalars.buy_share(key % 7, key % 5).alias("buy_share"), scalars.percent_text((key % 8) / 8).alias("percent"), scalars.money_text((key % 900 * F.when(key % 900 >= 10, 1000).otherwise(100)).cast("double")).alias("money"),
        divergence_flag((key % 10) / 100).alias("flag"),
    )


@query(f"WITH m AS ({MEMBERS}) SELECT name, chamber, party, state, district, 'a ' || name AS aliases, row_number() OVER (ORDER BY name, chamber) - 1 AS position FROM m")
def roster_round_trip(spark, sf_dir):
    """A roster document, written by name and read back."""
    path = owned(spark, "roster")
    sinks.publish_roster(members(spark, sf_dir).withColumn("aliases", F.array(F.concat(F.lit("a "), "name"))), path)
    found = readers.read_roster(spark, path)
    return found.withColumn("aliases", F.array_join("aliases", "|"))


@query(f"WITH t AS ({TRADES}) SELECT 'trade' AS what, CAST(id AS VARCHAR) AS id, member, ticker, type, tx_date, amount_lo, amount_hi FROM t UNION ALL SELECT 'skip', 'f' || CAST(c_custkey AS VARCHAR), c_name, NULL, 'paper', DATE '2001-01-01', NULL, NULL FROM customer")
def line_round_trip(spark, sf_dir):
    """Trades and skipped filings, written as lines and read back side by side."""
    path = owned(spark, "lines")
    rows = trades(spark, sf_dir).withColumn("id", F.col("id").cast("string")).withColumn("filing_date", F.col("tx_date"))
    skipped = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("filing_id"), F.col("c_name").alias("member"), F.lit("2001-01-01").cast("date").alias("filing_date"), F.lit("paper").alias("reason"))
    sinks.publish_lines(rows, skipped, path)
    back, none = readers.read_json_lines(spark, path), F.lit(None)
    found = back["trades"].select(F.lit("trade").alias("what"), "id", "member", "ticker", "type", "tx_date", "amount_lo", "amount_hi")
    return found.union(back["skipped_filings"].select(F.lit("skip"), "filing_id", "member", none.cast("string"), "reason", "filing_date", none.cast("long"), none.cast("long")))


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS filing_id, c_mktsegment || ' ' || c_name AS member, 'TX' AS state, 'TX-' || CAST(c_custkey % 40 AS VARCHAR) AS district, make_date(2000 + c_custkey % 2, 3, CAST(1 + c_custkey % 28 AS INT)) AS filing_date,
           'https://p/' || CAST(2000 + c_custkey % 2 AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) || '.pdf' AS source_url, c_custkey % 4 = 1 AS is_paper FROM customer WHERE c_custkey % 5 <> 0
    """
)
def yearly_indexes(spark, sf_dir):
    """Two yearly indexes, written with tabs and read back with the filings' texts; every fourth filing is a scan."""
    path, key = owned(spark, "indexes"), F.col("c_custkey")
    say = lambda x: F.lit(x)
    for year in (1999, 2000, 2001):  # the first is outside the window
        day = F.date_format(F.make_date(F.lit(year), F.lit(3), (1 + key % 28).cast("int")), "M/d/yyyy")
        values = (say("Hon."), F.col("c_name"), F.col("c_mktsegment"), say(""), F.when(key % 5 != 0, "P").otherwise("A"), F.format_string("TX%02d", key % 40), say(str(year)), day, key.cast("string"))
        rows = table(spark, sf_dir, "customer").filter(F.lit(year) == 2000 + key % 2 if year > 1999 else key % 3 == 0)
        rows.select(*(v.alias(c) for v, c in zip(values, readers.INDEX_COLUMNS, strict=True))).write.option("sep", "\t").option("header", True).csv(f"{path}/{year}FD.txt")
    texts = table(spark, sf_dir, "customer").select(key.cast("string").alias("filing_id"), F.when(key % 4 == 1, "scan").otherwise(F.repeat(F.lit("text "), 30)).alias("text"))
    found = filings.house_filings(readers.read_yearly_indexes(spark, path, "2001-08-01"), texts, "https://p", readers.layered_text)
    return found.select("filing_id", "member", "state", "district", "filing_date", "source_url", "is_paper")


@query(f"WITH {PRICED} SELECT 'return' AS what, CAST(p.id AS VARCHAR) AS key, b.tx_date >= e.d AS dated, CAST(format('{{:.4f}}', e.c) AS DOUBLE) AS close, CAST(format('{{:.1f}}', (p.close - e.c) / e.c * 100) AS DOUBLE) AS pct FROM priced p JOIN buys b USING (id) ASOF JOIN prices e ON b.ticker = e.ticker AND b.tx_date >= e.d UNION ALL SELECT 'price', ticker, true, CAST(format('{{:.4f}}', any_value(close)) AS DOUBLE), NULL FROM priced GROUP BY ticker")
def returns_round_trip(spark, sf_dir):
    """The returns document, written by key and read back."""
    path = owned(spark, "returns")
    bought, prices = _buys(spark, sf_dir)
    found = returns.buy_returns(bought, prices)
    sinks.publish_returns_document(found, returns.ticker_prices(found), {"source": "charts"}, path)
    back = readers.read_returns_lines(spark, path)
    dated = back["returns"].join(bought.select(F.col("id").cast("string").alias("id"), "tx_date"), "id")
    out = dated.select(F.lit("return").alias("what"), F.col("id").alias("key"), (F.col("tx_date") >= F.col("entry_date")).alias("dated"), F.col("entry_close").alias("close"), "pct")
    return out.union(back["prices"].select(F.lit("price"), "ticker", F.col("asof_date").isNotNull(), "asof_close", F.lit(None).cast("double")))


@query(
    f"""
    WITH r AS ({ROWS}), n AS (SELECT f, count(*) AS n FROM r GROUP BY f),
         s AS (SELECT c_custkey AS f, c_name, coalesce(n, 0) AS n, c_custkey % 50 = 7 AS bad, CASE WHEN c_custkey % 10 = 3 THEN 'paper' WHEN c_custkey % 50 = 7 OR n IS NULL THEN 'parse_error' ELSE 'read' END AS state FROM customer LEFT JOIN n ON f = c_custkey WHERE NOT {OLD}),
         t AS (SELECT * FROM s WHERE state = 'read' OR (state = 'parse_error' AND n > 0))
    SELECT '1 fetched' AS what, CAST(count(*) AS VARCHAR) AS value FROM s
    UNION ALL SELECT '1 new trades', CAST(coalesce(sum(n) FILTER (state = 'read'), 0) AS VARCHAR) FROM s UNION ALL SELECT '1 paper', CAST(count(*) FILTER (state = 'paper') AS VARCHAR) FROM s
    UNION ALL SELECT '1 errors', CAST(count(*) FILTER (state = 'parse_error') AS VARCHAR) FROM s UNION ALL SELECT '1 recovered', '0' UNION ALL SELECT '1 version', '2001-08-01.1'
    UNION ALL SELECT '2 fetched', CAST(count(*) FILTER (state = 'parse_error') AS VARCHAR) FROM s UNION ALL SELECT '2 new trades', CAST(coalesce(sum(n) FILTER (state = 'parse_error'), 0) AS VARCHAR) FROM s UNION ALL SELECT '2 paper', '0'
    UNION ALL SELECT '2 errors', CAST(count(*) FILTER (state = 'parse_error' AND n = 0) AS VARCHAR) FROM s UNION ALL SELECT '2 recovered', CAST(count(*) FILTER (state = 'parse_error' AND n > 0) AS VARCHAR) FROM s UNION ALL SELECT '2 version', '2001-08-01.2'
    UNION ALL SELECT 'trades', CAST(coalesce(sum(n), 0) AS VARCHAR) FROM t UNION ALL SELECT 'members', CAST(count(*) FILTER (n > 0) AS VARCHAR) FROM t
    UNION ALL SELECT 'processed', CAST(count(*) FILTER (state = 'paper' OR state = 'read' OR n > 0) AS VARCHAR) FROM s UNION ALL SELECT 'skipped', CAST(count(*) FILTER (state = 'paper' OR (state = 'parse_error' AND n = 0)) AS VARCHAR) FROM s
    UNION ALL SELECT 'featured', 'AFRICA Q. NATION_0|Nobody Known'
    UNION ALL SELECT 'window', '2000-01-01 2001-08-01'
    """.replace("AFRICA Q. NATION_0|", "' || (SELECT r_name || ' Q. ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 0) || '|")
)
def run_counters(spark, sf_dir):
    """What two runs of one day count, the second with the unreadable filings mended, and the dataset's meta."""
    data = incremental.Dataset(spark, owned(spark, "dataset"))
    rows, roster = saved(_as_filings(spark, sf_dir), "filings"), members(spark, sf_dir)
    mended = rows.withColumn("text", F.regexp_replace("text", "\nOdd Corp .*$", ""))
    first = roster.filter("position = 0").first().name  # one name of the roster
    found = []
    for k, given in enumerate((rows, mended), 1):
        r = incremental.run(data, given, filings.text_trades, roster, "2001-08-01", "now", [f"Hon. {first}", "Nobody Known"])
        counts = {"fetched": r.fetched, "new trades": r.new_trades, "paper": r.paper_skips, "errors": r.parse_errors, "recovered": r.recovered_errors, "version": r.version}
        found += [(f"{k} {name}", str(value)) for name, value in counts.items()]
    counts = {"trades": "trades", "members": "members", "processed": "filings_processed", "skipped": "filings_skipped"}
    told = {name: F.col(f"counts.{c}").cast("string") for name, c in counts.items()}
    told |= {"featured": F.array_join("featured", "|"), "window": F.concat_ws(" ", F.col("window.from").cast("string"), F.col("window.to").cast("string"))}
    meta = data.read("meta").select(F.explode(F.array(*(F.struct(F.lit(n).alias("what"), c.alias("value")) for n, c in told.items()))).alias("x")).select("x.*")
    return spark.createDataFrame(found, "what string, value string").unionByName(meta)


@query(
    f"WITH t AS ({TRADES}), x AS (SELECT ticker, count(*) FILTER (type = 'buy') AS buys, count(*) FILTER (type = 'sell') AS sells FROM t WHERE tx_date >= DATE '2001-05-03' GROUP BY 1), "
    "y AS (SELECT ticker, buys, sells, buys + sells AS total FROM x WHERE buys + sells > 0 ORDER BY total DESC, ticker LIMIT 10) SELECT *, total / CAST(max(total) OVER () AS DOUBLE) AS bar FROM y"
)
def ticker_bars(spark, sf_dir):
    """The ten most traded tickers of the last 90 days, with their share of the first one's trades."""
    return views.top_tickers(trades(spark, sf_dir), "2001-08-01")


@query(f"WITH p AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE NOT {OLD}) SELECT 'house' AS chamber, 'f' || CAST(c_custkey AS VARCHAR) AS filing_id, c_name AS member, DATE '2001-07-01' AS filing_date FROM p WHERE k <= 25")
def capped_run(spark, sf_dir):
    """The first 25 filings of the listing that a capped run would fetch."""
    return incremental.planned(incremental.Dataset(spark, owned(spark, "dataset")), _as_filings(spark, sf_dir), "2001-08-01", 25)


@query("SELECT n_nationkey AS position, n_name AS name FROM nation")
def featured_list(spark, sf_dir):
    """A list of names, written as a JSON array and read back with places."""
    path = owned(spark, "featured")
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    table(spark, sf_dir, "nation").agg(F.to_json(names).alias("value")).write.text(path)
    return readers.read_featured(spark, path)


@query("SELECT 'txt' AS kind, CAST(sum(length(c_name) + length(c_mktsegment) + 2) AS BIGINT) AS n_bytes FROM customer")
def stored_documents(spark, sf_dir):
    """Files told apart by their suffix, and the bytes in them."""
    path = owned(spark, "documents")
    table(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("value")).write.text(path)
    return readers.read_documents(spark, f"{path}/part-*").groupBy("kind").agg(F.sum(F.octet_length("content")).alias("n_bytes"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE event_type WHEN 'click' THEN -8 WHEN 'error' THEN -3 ELSE -6 END) AS BIGINT) AS hundredths FROM events GROUP BY 1")
def style_rho(spark, sf_dir):
    """Kinds of events as styles of play: two known ones and others."""
    from ledgerlark.operators import probability

    style = F.when(F.col("event_type") == "click", "low_block").when(F.col("event_type") == "error", "end_to_end").otherwise("unknown")
    rows = table(spark, sf_dir, "events").select("event_type", F.round(probability.style_rho(style) * 100).cast("long").alias("r"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("r").alias("hundredths"))


#: What a conversation as a document must look like.
CONVERSATION = {
    "type": "object", "additionalProperties": False, "required": ["id", "kind", "when", "turns"],
    "properties": {
        "id": {"type": "integer", "minimum": 0}, "kind": {"const": "chat"}, "when": {"type": "string", "format": "date-time"}, "name": {"type": "string", "pattern": "^c-[0-9]+$"},
        "score": {"type": "number", "exclusiveMaximum": 100},
        "turns": {"type": "array", "minItems": 1, "items": {"$ref": "#/definitions/turn"}},
    },
    "definitions": {"turn": {"type": "object", "additionalProperties": False, "required": ["turn", "text"], "properties": {"turn": {"type": "integer"}, "role": {"enum": ["user", "assistant"]}, "text": {"type": "string"}}}},
}


@query(
    """
    WITH c AS (SELECT conv_id, count(*) AS n, conv_id % 14 AS k FROM conversations GROUP BY conv_id),
         t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
         w AS (SELECT conv_id, string_agg('/turns/' || CAST(place AS VARCHAR) || '/turn type', '; ' ORDER BY CAST(place AS VARCHAR)) AS typed FROM t GROUP BY conv_id)
    SELECT conv_id, CASE k WHEN 1 THEN ' required' WHEN 2 THEN ' additionalProperties' WHEN 3 THEN '/id type' WHEN 4 THEN '/kind const' WHEN 5 THEN '/turns/0/role enum' WHEN 6 THEN '/turns/' || CAST(n - 1 AS VARCHAR) || ' required' WHEN 7 THEN '/when format'
           WHEN 8 THEN '/turns minItems' WHEN 9 THEN ' json' WHEN 10 THEN '/score exclusiveMaximum' WHEN 11 THEN '/name pattern' WHEN 12 THEN '/turns/0 additionalProperties' WHEN 13 THEN typed ELSE '' END AS breaches
    FROM c JOIN w USING (conv_id)
    """
)
def schema_breaches(spark, sf_dir):
    """Conversations as JSON documents, thirteen in fourteen of them changed in one way, and what of a schema each breaks."""
    turns = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 14
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    last = F.count("*").over(Window.partitionBy("conv_id")) - 1
    placed = turns.select("conv_id", place.alias("place"), last.alias("last"), F.col("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    own = F.to_json(F.struct(
        F.when(k != 13, F.col("turn")).alias("turn"), F.when(k == 13, F.col("turn").cast("string")).alias("_turn"), F.when((k == 5) & (F.col("place") == 0), "robot").otherwise(F.when(F.col("role").isin("user", "assistant"), F.col("role"))).alias("role"),
        F.when((k != 6) | (F.col("place") < F.col("last")), F.col("text")).alias("text"), F.when((k == 12) & (F.col("place") == 0), True).alias("odd"),
    ))
    listed = placed.select("conv_id", "place", F.replace(own, F.lit('"_turn"'), F.lit('"turn"')).alias("own"))
    listed = listed.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "own"))), lambda x: x["own"]), ",").alias("turns"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    name = F.col("conv_id").cast("string")
    body = say(
        '{"id":', F.when(k == 3, say('"', name, '"')).otherwise(name), F.when(k == 1, "").when(k == 4, ',"kind":"talk"').otherwise(',"kind":"chat"'), F.when(k == 2, ',"more":[]').otherwise(""),
        ',"when":"', F.when(k == 7, "2026-13-01T00:00:00Z").otherwise("2026-03-01T00:00:00Z"), '","score":', F.when(k == 10, "100").otherwise("99.5"), ',"name":"', F.when(k == 11, "C-").otherwise("c-"), name,
        '","turns":[', F.when(k == 8, "").otherwise(F.col("turns")), F.when(k == 9, "").otherwise("]}"),
    )
    found = schemas.checked(listed.select("conv_id", body.alias("payload")), CONVERSATION)
    return found.select("conv_id", F.array_join(F.transform("breaches", lambda b: F.concat_ws(" ", b["path"], b["keyword"])), "; ").alias("breaches"))


def _order_versions(spark, sf_dir: str) -> versions.VersionedTable:
    """Orders as three versions of a table: all, some changed and new ones merged, some deleted."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k, k.cast("string").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    held = versions.VersionedTable(spark, owned(spark, "versions"), "id string, price double, status string", buckets=64)
    held.merge(orders.drop("o_orderkey"))
    changed = orders.filter(k % 50 == 1).withColumn("price", F.col("price") + 1)
    new = orders.filter(k % 500 == 7).withColumn("id", F.concat(F.lit("n"), "id"))
    held.merge(changed.unionByName(new).drop("o_orderkey"))
    held.delete(lambda rows: rows.filter(F.col("id").try_cast("long") % 70 == 3))
    return held


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice + CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 70 <> 3
    UNION ALL SELECT 'n' || CAST(o_orderkey AS VARCHAR), o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 500 = 7
    """
)
def merged_versions(spark, sf_dir):
    """What a table of orders holds after a merge and a deletion that rewrite only some of its files."""
    return _order_versions(spark, sf_dir).read()


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 70 = 3 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 70 = 3 OR o_orderkey % 50 = 1
    UNION ALL SELECT 'n' || CAST(o_orderkey AS VARCHAR), 'added' FROM orders WHERE o_orderkey % 500 = 7
    """
)
def version_changes(spark, sf_dir):
    """The orders by which the first and the last version differ, found by going down their hash trees."""
    return _order_versions(spark, sf_dir).changes(1, 3)


@query(
    """
    WITH e AS (SELECT user_id AS page, event_id, event_id % 4 AS k, CAST(200 + event_id % 300 AS INT) AS status, '/a/' || event_type AS url FROM events)
    SELECT page, CASE k WHEN 0 THEN 'error' ELSE 'failure' END AS what,
           CASE k WHEN 0 THEN 'Uncaught: no ' || CAST(event_id AS VARCHAR) WHEN 1 THEN 'GET ' || url || ' — ' || CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'reset' END ELSE CAST(status AS VARCHAR) || ' POST ' || url END AS text
    FROM e WHERE k = 0 OR (url <> '/a/click' AND (k = 1 OR (k = 2 AND status >= 400)))
    """
)
def browser_problems(spark, sf_dir):
    """Events as a log of browser events: errors, failed requests and answers, those of clicks being expected to fail."""
    k = F.col("event_id") % 4
    url = F.concat(F.lit("/a/"), "event_type")
    kind = F.when(k == 0, "pageerror").when(k == 1, "requestfailed").when(k == 2, "response").otherwise("console")
    event = F.to_json(F.struct(
        kind.alias("kind"), F.when(k == 0, F.concat(F.lit("no "), F.col("event_id").cast("string"))).alias("message"), F.when(k == 1, "GET").otherwise("POST").alias("method"), url.alias("url"),
        (200 + F.col("event_id") % 300).cast("int").alias("status"), F.when(F.col("event_id") % 3 != 0, "reset").alias("error"),
    ))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), event.alias("event"))
    return contracts.browser_problems(log, r"/a/click\b")


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part WHERE contains(lower(p_name), 'd wi') OR contains(lower(p_brand), 'd#13')")
def indexed_search(spark, sf_dir):
    """Parts found by a piece of their name or brand, through an index of trigrams."""
    path = owned(spark, "searchable")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    trigrams.write_searchable(parts, path, ["name", "brand"], ["brand"])
    found = trigrams.search(spark, path, ["brand"], "D#13")
    return found.union(trigrams.search(spark, path, ["name"], "D Wi")).distinct()
