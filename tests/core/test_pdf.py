import random
import zlib

from pyspark.sql import functions as F

from ledgerlark.__main__ import main
from ledgerlark.plans.pdf_files import pdf_file, pdf_files
from ledgerlark.sources.pdf import Document, file_runs, glyph_runs, page_lines, pdf_texts, read_pdfs, values


def assembled(*objects, more=b""):
    """A file of numbered objects; a stream comes as (dictionary, bytes)."""
    out = b"%PDF-1.7\n"
    for k, o in enumerate(objects, 1):
        body = o if isinstance(o, bytes) else o[0][:-2] + b"/Length %d >>\nstream\n" % len(o[1]) + o[1] + b"\nendstream"
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    return out + more


def one_page(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>", *others):
    return assembled(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F 4 0 R >> /XObject << /X 6 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", font, (b"<< >>", content), *others)


def lines(spark, *contents):
    files = spark.createDataFrame([(f"f{k}", c) for k, c in enumerate(contents)], "path string, content binary")
    return [(r.path, r.page, r.text, list(r.cells)) for r in page_lines(glyph_runs(files)).orderBy("path", "page", "line").collect()]


def test_values_of_all_kinds():
    data = rb"<< /A#20b [1 -2.5 .5 true null (a\(b\)(c)\101\n) <4a4B5> 7 0 R] >> % words (not this)" + b"\nBT /F1 12 Tf (x) Tj ID \x00\xff EI q"
    found = [v for v, _ in values(data)]
    assert found[0] == {"A b": [1, -2.5, 0.5, True, None, b"a(b)(c)A\n", b"JKP", 7]}
    assert [str(v) for v in found if isinstance(v, str)] == ["BT", "F1", "Tf", "Tj", "ID", "q"]


def test_operators_move_the_text(spark):
    content = b"""q 1 0 0 1 10 0 cm BT /F 10 Tf 14 TL 20 700 Td (one) Tj 24 0 Td (two) Tj T* (below) ' 1 2 (spaced out) " ET Q
    BT /F 10 Tf 1 0 0 1 100 690 Tm [(kern) -50 (ed) -3000 (far)] TJ 2 Ts (up) Tj ET BT /F 10 Tf 50 Tz 0 600 Td (ab) Tj 100 Tz 14 0 Td (c) Tj ET /X Do BI /W 1 ID (\xff)Tj EI"""
    form = (b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 500] >>", b"BT /F 10 Tf (in a form) Tj ET")
    found = lines(spark, one_page(content, b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>", form))
    assert [t for _, _, t, _ in found] == ["one two", "kerned farup", "below", "spaced out", "ab c", "in a form"]
    assert found[1][3] == ["kerned", "farup"]


def test_fonts_with_maps_widths_and_differences(spark):
    cmap = b"2 beginbfrange <0001> <0003> <0041> <0010> <0011> [<00660069> <d835dd04>] endbfrange 1 beginbfchar <20> <2013> endbfchar"
    wide = assembled(
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Resources << /Font << /F 4 0 R >> >> /Contents [5 0 R 8 0 R] >>",
        b"<< /Type /Font /Subtype /Type0 /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", (b"<< /Filter /ASCIIHexDecode >>", b"BT /F 10 Tf 0 700 Td <000100020003> Tj".hex().encode() + b">"),
        b"<< /Type /Font /DW 1000 /W [1 [500 500] 3 3 2000] >>", (b"<< >>", cmap), (b"<< /Filter /FlateDecode >>", zlib.compress(b"30 0 Td <00100011> Tj 0 -20 Td <0020> Tj ET")),
    )
    simple = one_page(b"BT /F 10 Tf 0 700 Td (A\x80B\x92) Tj 40 0 Td (C) Tj ET", b"<< /Type /Font /Subtype /TrueType /FirstChar 65 /Widths [1000 1000 500] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [66 /uni00E9 /Z] >> >>")
    assert [t for _, _, t, _ in lines(spark, wide, simple)] == ["ABCfi𝔄", "–", "A€é’ Z"]


def test_objects_in_streams_later_versions_and_wrong_lengths():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 9 0 R /Resources << /Font << /F 4 0 R >> >> >>", b"<< /Type /Font /Subtype /Type1 >>"]
    heads, body = b"", b""
    for k, o in enumerate(inner, 1):
        heads += b"%d %d " % (k, len(body))
        body += o + b" "
    packed = zlib.compress(heads + body)
    data = b"%PDF-1.5\n8 0 obj << /Type /ObjStm /N 4 /First " + b"%d" % len(heads) + b" /Filter /FlateDecode /Length 8888 >> stream\r\n" + packed + b"\nendstream endobj\n"
    data += b"9 0 obj << /Length 3 >> stream\nBT /F 9 Tf (old) Tj ET\nendstream endobj 9 0 obj << /Length 10 0 R >> stream\nBT /F 9 Tf (new) Tj ET\nendstream endobj 10 0 obj 22 endobj"
    runs, wrong = file_runs(data)
    assert wrong is None and [r[6] for r in runs] == ["new"]
    assert len(Document(data).objects) == 7


def test_scans_and_unreadable_files_have_no_text(spark):
    image = one_page(b"q 100 0 0 100 0 0 cm /X Do Q", b"<< >>", (b"<< /Type /XObject /Subtype /Image /Filter /DCTDecode >>", b"\xff\xd8 endobj 5 0 obj"))
    locked = one_page(b"BT /F 9 Tf (secret) Tj ET") + b"trailer << /Root 1 0 R /Encrypt 9 0 R >>"
    rows = [("scan", image), ("locked", locked), ("none", None), ("empty", b""), ("page", b"<html></html>"), ("cut", pdf_file("a line " * 5)[:300]), ("short", pdf_file("under fifty letters")), ("text", pdf_file("x y" * 20 + "\nz"))]
    got = {r.path: (r.text, r.error) for r in pdf_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got.pop("text") == ("x y" * 20 + "\nz", None)
    assert {k for k, (_, error) in got.items() if error} == {"locked", "none", "empty", "page"} and {t for t, _ in got.values()} == {""}
    assert pdf_texts(spark.createDataFrame(rows[:0], "path string, content binary")).count() == 0


def test_a_long_file_comes_back_line_by_line(spark):
    rng = random.Random(4)
    text = "\n".join(" ".join(rng.choice(["é", "(a)", "b\\c", "$1,001", "-", "word"]) for _ in range(rng.randint(1, 12))) for _ in range(3000))
    texts = spark.createDataFrame([("p", text)], "path string, text string")
    assert pdf_texts(pdf_files(texts)).first().text == text
    assert page_lines(glyph_runs(pdf_files(texts))).agg(F.max("page"), F.count("*")).first() == (75, 3000)


def test_command_reads_a_pdf(spark, tmp_path, capsys):
    row = "SP Nova Corp (NVA) [ST] P 05/03/2001 05/04/2001 $1,001 - $15,000"
    for name, text in (("a.pdf", f"Filing ID #7\n{row}\nF S: New\nDigitally signed by somebody"), ("scan.pdf", "")):
        (tmp_path / name).write_bytes(pdf_file(text))
    assert main(["parse-ptr", str(tmp_path / "a.pdf")]) == 0
    assert '"ticker":"NVA"' in capsys.readouterr().out
    assert main(["parse-ptr", str(tmp_path / "scan.pdf")]) == 1 and main(["parse-ptr", str(tmp_path / "a.doc")]) == 2
    assert [r.filing_id for r in read_pdfs(spark, f"{tmp_path}/*.pdf").orderBy("filing_id").collect()] == ["a", "scan"]
