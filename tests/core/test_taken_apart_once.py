"""Filings, pages and files are taken apart once, in as many tasks as there are shuffle partitions."""

from pyspark.sql import functions as F

from ledgerlark.functions import scalars as s
from ledgerlark.operators import filings as f
from ledgerlark.plans import filing_queries as q
from ledgerlark.sources import html_tables, pdf

META = "CAST(NULL AS STRING) AS member, CAST(NULL AS STRING) AS state, CAST(NULL AS STRING) AS district, CAST(NULL AS DATE) AS filing_date, CAST(NULL AS STRING) AS source_url"
DIR = "/root/testdata/sf0.001"


def nodes(df, name):
    return sum(line.lstrip(" :+-").startswith((name, f"*({name}")) for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_texts_are_split_once(spark):
    found = q.text_trades(spark, DIR)
    assert nodes(found, "Generate") == 1 and nodes(found, "RepartitionByExpression") == 1


def test_pages_are_parsed_once(spark):
    found = q.table_trades(spark, DIR)
    assert nodes(found, "MapInArrow") == 1 and nodes(found, "RepartitionByExpression") == 1


def test_rows_tell_each_other_of_an_unreadable_one(spark):
    row = "Nova Corp P 05/03/2001 05/04/2001 {}"
    texts = {"good": [row.format("$1,001 - $15,000")] * 2, "bad": [row.format("$1,001 - $15,000"), row.format("None")], "none": ["words / words"], "slash": ["A/B", row.format("$1,001 -"), "C/D\\E", "$15,000"]}
    docs = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "filing_id string, text string").selectExpr("*", *META.split(", "))
    got = sorted((r.filing_id, r.id or "", r.asset or "", r.amount_hi or 0, r.error or "") for r in f.text_trades(docs).collect())
    assert [g for g in got if g[0] != "slash"] == [("bad", "", "Nova Corp", 15000, "unreadable row"), ("good", "house:good:0", "Nova Corp", 15000, ""), ("good", "house:good:1", "Nova Corp", 15000, ""), ("none", "", "", 0, "no transaction rows")]
    assert [g for g in got if g[0] == "slash"] == [("slash", "house:slash:0", "Nova Corp C/D\\E", 15000, "")]


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    pages = [
        "", "no tags & none", "<table><tr><td>a<b>b</b> c</td><th>&amp;&lt;&#233; &am<i>p;</td></tr><tr></tr></table>", "x<TABLE class='a' id=\"b\" w=3><TR ><TD nowrap>1<td>2</TD ></table>after",
        "<table><tr><td>a<table><tr><td>in</table>b</td></tr></table><tr><td>out", "<td>free</td><table><td>rowless</td><tr><td>  a \n b &nbsp;",
    ]
    odd = ["<table><tr><td>a<!-- <td>no</td> --></td></tr>", "<table><tr><td><script>'<td>'</script>x", "<table><tr><td>1 < 2</td></tr>", "<table><tr><td/>a</tr>", "<table><tr><td title='a>b'>x", "<table><tr><td>cut <td", "<table><tr><td a=b/c>x</td x></tr>"]
    assert all(html_tables._plain_rows(p) is not None for p in pages)
    quick = [html_tables.table_rows(p) for p in pages + odd]
    monkeypatch.setattr(html_tables, "_plain_rows", lambda html: None)
    assert quick == [html_tables.table_rows(p) for p in pages + odd]


def test_blanks_of_all_kinds_go(spark):
    blanks = s.BLANKS
    texts = ["", " ", blanks, f"{blanks}a{blanks}b c{blanks}", "a b  c", "a​b", "​a\x1c", "a b\tc"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", ""), F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    assert df.filter((s.strip("t") != plain[0]) | (s.collapse("t") != plain[1])).count() == 0
    every = spark.range(1, 0x3100).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.concat(F.unhex(F.lpad(F.hex("id"), 4, "0"))), "UTF-16BE").alias("t"))
    assert every.filter((s.strip("t") == "") != F.col("t").rlike(r"(?U)^\s$")).count() == 0


def test_small_files_share_a_batch_and_common_operations_are_matched_whole(spark, monkeypatch):
    content = b"BT /F 10 Tf 1 0 0 1 5 700 Tm (a \\(b\\)) Tj 1 0 0 1 50 700.5 Tm <4142> Tj 0 -20 Td (c\\101) Tj -.5 +3. Td (d(e)) Tj true Tj null 5 Td (f) Tj 1 2 3 4 5 6 7 8 9 1 0 0 1 9 600 Tm (g)Tj\x00(h) Tj ET BI /W 1 ID (x) Tj EI (i) Tj"
    doc = pdf.Document(b"%PDF-1.4\n1 0 obj << /F 2 0 R >> endobj 2 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Courier >> endobj")
    read = lambda: pdf.Reader(doc).page(content, {"Font": {"F": pdf.Ref(2)}})
    quick = read()
    monkeypatch.setattr(pdf, "_PLAIN", pdf.re.compile(b"(?!)"))
    assert quick == read() and [r[4] for r in quick] == ["a (b)", "AB", "cA", "d(e)", "f", "g", "h", "i"]
    monkeypatch.undo()
    files = spark.createDataFrame([(f"f{k}", b"none") for k in range(500)], "path string, content binary").coalesce(1)
    monkeypatch.setattr(pdf, "BATCH", 64)
    assert pdf.glyph_runs(files).filter("error = 'not a PDF file'").select("path").distinct().count() == 500
