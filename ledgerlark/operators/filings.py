"""Filings to trades: line state machine over extracted text, table rows of pages, listings and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as s

# Patterns of a filing's text lines.
ROW = r"^(?:(SP|JT|DC)\s+)?(.+?)\s+(S \(partial\)|P|S|E)\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}/\d{2}/\d{4})\s+(\$[\d,]+(?:\s*[-–]\s*\$?[\d,]*)?|None)\s*$"
META = r"^\(?(F\s+S|S\s+O|D|C|L)\s*:\s*"
SKIP = (
    r"(?i)(clerk of the house|house of representatives|financial disclosure|periodic transaction|filing id|state/district|transactions?$"
    r"|^id\s+owner\s+asset|^type\s+date|^asset\s+|notification|amount|cap\.?\s*gains|^\*|initial public offering|^name:|^status:"
    r"|^page \d|^https?://|i\s+p\s+o|^yes\b|^no\b|certify|digitally signed|knowledge and belief|electronically filed|^signature)"
)
TRADE_COLUMNS = (
    "id", "chamber", "member", "party", "state", "district", "ticker", "asset", "asset_type", "type", "partial", "owner",
    "tx_date", "filing_date", "amount_lo", "amount_hi", "amount_label", "filing_id", "source_url",
)
FILING_COLUMNS = ["chamber", "filing_id", "member", "state", "district", "filing_date", "source_url", "is_paper", "text", "html"]
LINK = r"(?s)href=['\"]([^'\"]+)['\"][^>]*>(.*?)</a>"


def line_groups(lines: DataFrame, by: str, opens: Column, order: str = "pos") -> DataFrame:
    """``lines`` with ``gid``, the number of opening lines up to each; lines before the first are left out."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("gid", F.sum(opens.cast("int")).over(upto)).filter("gid > 0")


def text_trades(filings: DataFrame) -> DataFrame:
    """Trades of filings given as extracted text, and one row with ``error`` for each filing that can't be read.

    ``filings``: filing_id, member, state, district, filing_date, source_url, text. A line that
    reads as a transaction opens a group; a metadata line closes the asset's name; boilerplate is
    skipped; while the amount ends with a dash, the next line with dollars completes it with its
    last amount; other lines go on with the name until it is closed. One unreadable row fails its
    filing, as does a filing without rows.
    """
    clean = s.strip(F.replace(F.col("line"), F.lit("\x00"), F.lit(" ")))
    split = F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"))
    parts = int(filings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: texts are small, taking them apart isn't
    lines = filings.select("filing_id", "text").repartition(parts, "filing_id").select("filing_id", split.alias("pos", "line")).withColumn("line", clean).filter("line <> ''")
    fields = F.regexp_replace("line", ROW, "\n$1\n$2\n$3\n$4\n$6")  # all fields by one match; no line holds a new line
    lines = lines.withColumn("_row", F.when(F.contains("line", F.lit("/")), fields)).withColumn("is_row", F.coalesce(F.startswith("_row", F.lit("\n")), F.lit(False)))
    lines = lines.withColumn("_row", F.when(F.col("is_row"), F.split("_row", "\n")))
    lines = line_groups(lines, "filing_id", F.col("is_row"))
    lines = lines.filter(F.col("is_row") | ~F.col("line").rlike(SKIP)).withColumn("is_meta", ~F.col("is_row") & F.col("line").rlike(META))
    group = Window.partitionBy("filing_id", "gid").orderBy("pos")
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("filing_id", "gid")
    part = lambda k: F.get("_row", F.lit(k))
    lines = lines.withColumns({"closed": F.max("is_meta").over(upto), "amount": F.max(part(5)).over(whole)})
    money = F.regexp_extract_all("line", F.lit(r"(\$[\d,]+)"), 1)
    may_wrap = ~F.col("is_row") & ~F.col("is_meta") & F.col("amount").rlike(r"[-–]\s*$") & (F.size(money) > 0)
    lines = lines.withColumn("wrap", F.min(F.when(may_wrap, F.col("pos"))).over(whole))
    last = F.element_at(money, -1)
    head = F.left("line", F.length("line") - F.position(F.reverse(last), F.reverse("line")) - F.length(last) + 1)
    name = F.when(F.col("is_row"), part(2)).when(F.col("is_meta") | F.col("closed"), None).when(F.col("pos") == F.col("wrap"), s.strip(head)).otherwise(F.col("line"))
    lines = lines.withColumn("name", s.blank_to_null(name)).withColumn("completed", F.when(F.col("pos") == F.col("wrap"), last))
    rows = lines.groupBy("filing_id", "gid").agg(
        *(F.max(part(k)).alias(c) for k, c in ((1, "owner"), (3, "kind"), (4, "day"), (5, "amount"))),
        F.max("completed").alias("completed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name")))), lambda x: x["name"]), " ").alias("full"),
    )
    amount = F.when(F.col("completed").isNotNull(), F.concat(F.regexp_replace("amount", r"[ \-–]+$", ""), F.lit(" - "), F.col("completed"))).otherwise(F.col("amount"))
    rows = rows.withColumns({"tx": s.parse_tx_type("kind"), "bracket": s.parse_amount(amount), "tx_date": s.parse_date("day"), "place": F.col("gid") - 1})
    shaped = rows.select(
        "filing_id", "place", s.listed_ticker("full").alias("ticker"), s.plain_asset("full").alias("asset"), s.listed_asset_type("full").alias("asset_type"),
        F.col("tx.type").alias("type"), F.col("tx.partial").alias("partial"), s.blank_to_null("owner").alias("owner"), "tx_date", "bracket",
    )
    return _trades_or_errors(filings, shaped, "house")


def _trades_or_errors(filings: DataFrame, rows: DataFrame, chamber: str) -> DataFrame:
    """The rows in the shape of trades with a null ``error``, or for a filing with an unreadable row, or with none, one row with its error. Rows are taken from the filings once: each is told of the others by a window."""
    bad = F.col("type").isNull() | F.col("bracket").isNull() | F.col("tx_date").isNull()
    rows = rows.withColumn("bad", F.max(bad).over(Window.partitionBy("filing_id"))).filter("NOT bad OR place = 0")
    meta = filings.select("filing_id", "member", "state", "district", "filing_date", "source_url")
    error = F.when(F.col("bad").isNull(), "no transaction rows").when(F.col("bad"), "unreadable row")
    out = meta.join(rows, "filing_id", "left").withColumn("error", error)
    good = F.col("error").isNull()
    fields = {
        "id": F.when(good, F.concat_ws(":", F.lit(chamber), "filing_id", F.col("place").cast("string"))),
        "chamber": F.lit(chamber),
        "party": F.lit(None).cast("string"),
        "amount_lo": F.col("bracket.lo"),
        "amount_hi": F.col("bracket.hi"),
        "amount_label": F.col("bracket.label"),
    }
    return out.withColumns(fields).select(*TRADE_COLUMNS, "error")


def table_trades(filings: DataFrame, tables: DataFrame) -> DataFrame:
    """Trades of filings given as pages, from their table rows (filing_id, table_no, row_no, cells), or their errors.

    The first table with 'transaction date' and 'amount' in one of its first two rows is read, or
    else a page's only table; of it, the rows whose first cell is a number.
    """
    header = F.lower(F.array_join("cells", " "))
    is_header = (F.col("row_no") < 2) & header.contains("transaction date") & header.contains("amount")
    whole = Window.partitionBy("filing_id")  # pages are taken apart once
    first, last = F.min("table_no").over(whole), F.max("table_no").over(whole)
    chosen = F.coalesce(F.min(F.when(is_header, F.col("table_no"))).over(whole), F.when(first == last, first))
    rows = tables.withColumn("_chosen", chosen).filter("table_no = _chosen").filter(F.element_at("cells", 1).rlike(r"^\d+\.*$"))
    cell = lambda k: F.try_element_at("cells", F.lit(k))
    place = F.row_number().over(Window.partitionBy("filing_id").orderBy("row_no")) - 1
    tx, bracket = s.parse_tx_type(cell(7)), F.when(F.size("cells") >= 8, s.parse_amount(cell(8)))
    shaped = rows.select(
        "filing_id", place.alias("place"), s.clean_ticker(cell(4)).alias("ticker"), cell(5).alias("asset"), s.blank_to_null(cell(6)).alias("asset_type"),
        tx["type"].alias("type"), tx["partial"].alias("partial"), s.owner_code(cell(3)).alias("owner"), s.parse_date(cell(2)).alias("tx_date"), bracket.alias("bracket"),
    )
    return _trades_or_errors(filings, shaped, "senate")


def listing_rows(pages: DataFrame, base: str, payload: str = "payload") -> DataFrame:
    """Filings of listing pages (JSON with ``data``, an array of rows of cells): filing_id, name, filed_date, url, is_paper, title, error.

    The link and the date are found by what they look like, the names by their places; a page
    without data, and a row that is too short or lacks a link or a date, gives an error.
    """
    parsed = F.from_json(payload, "struct<data:array<array<string>>>")["data"]
    rows = pages.select(F.explode_outer(parsed).alias("cells"))
    first = lambda pattern: F.try_element_at(F.filter("cells", lambda c: c.rlike(pattern)), F.lit(1))
    link, day = first(LINK), first(r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$")
    url = s.absolute_url(F.regexp_extract(link, LINK, 1), base)
    error = F.when(F.col("cells").isNull(), "no data").when(F.size("cells") < 4, "row too short").when(link.isNull(), "no report link").when(day.isNull(), "no filed date")
    return rows.select(
        s.last_segment(url).alias("filing_id"),
        s.strip(F.concat_ws(" ", s.strip(F.try_element_at("cells", F.lit(1))), s.strip(F.try_element_at("cells", F.lit(2))))).alias("name"),
        s.parse_date(day).alias("filed_date"),
        url.alias("url"),
        url.contains("/search/view/paper/").alias("is_paper"),
        s.collapse(F.regexp_extract(link, LINK, 2)).alias("title"),
        error.alias("error"),
    )


def house_filings(index: DataFrame, texts: DataFrame, base: str, layered) -> DataFrame:
    """What incremental.run() reads of the house: the index's filings with their extracted texts (filing_id, text). One whose text ``layered`` makes empty is a scan, so a paper filing."""
    rows = index_filings(index, base).join(texts, "filing_id").withColumn("text", layered("text"))
    return rows.withColumns({"chamber": F.lit("house"), "is_paper": F.coalesce(F.col("text"), F.lit("")) == "", "html": F.lit(None).cast("string")}).select(FILING_COLUMNS)


def senate_filings(listing: DataFrame, pages: DataFrame) -> DataFrame:
    """What incremental.run() reads of the senate: the filings of listing_rows() without an error, with their pages (filing_id, html), which paper filings lack."""
    none = F.lit(None).cast("string")
    rows = listing.filter("error IS NULL").join(pages, "filing_id", "left").filter("is_paper OR html IS NOT NULL")
    named = {"chamber": F.lit("senate"), "member": F.col("name"), "state": none, "district": none, "filing_date": F.col("filed_date"), "source_url": F.col("url"), "text": none}
    return rows.withColumns(named).select(FILING_COLUMNS)


def index_filings(index: DataFrame, base: str) -> DataFrame:
    """Transaction filings of a yearly index (Prefix, Last, First, Suffix, FilingType, StateDst, Year, FilingDate, DocID)."""
    lacking = {"Last", "First", "FilingType", "StateDst", "FilingDate", "DocID"} - set(index.columns)
    if lacking:
        raise ValueError(f"index without columns {sorted(lacking)}")
    place = s.state_district("StateDst")
    rows = index.filter((s.strip("FilingType") == "P") & (F.coalesce(s.strip("DocID"), F.lit("")) != ""))
    day = s.parse_date("FilingDate")
    url = F.concat(F.lit(base), F.lit("/"), F.year(day).cast("string"), F.lit("/"), s.strip("DocID"), F.lit(".pdf"))
    return rows.select(s.strip("DocID").alias("filing_id"), s.strip(F.concat_ws(" ", s.strip("First"), s.strip("Last"))).alias("member"), place["state"].alias("state"), place["district"].alias("district"), day.alias("filing_date"), url.alias("source_url"))
