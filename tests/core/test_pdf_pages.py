"""A page's runs stay in one row from the file to the lines, and what files share is taken apart once."""

import random
import re

from pyspark.sql import functions as F

from ledgerlark.functions import scalars as s
from ledgerlark.plans.pdf_files import pdf_file
from ledgerlark.sources import pdf
from tests.core.test_pdf import one_page
from tests.core.test_taken_apart_once import nodes

NEVER = re.compile(rb"(?:()()()()()()(?!))?")


def test_runs_are_not_shuffled(spark):
    files = spark.createDataFrame([("a", pdf_file("a line of words\nand one more"))], "path string, content binary")
    found = pdf.pdf_texts(files)
    assert nodes(found, "Window") == 0 and nodes(found, "Aggregate") == 1 and nodes(found, "MapInArrow") == 1
    assert nodes(pdf.file_lines(files), "Aggregate") == 0 and nodes(pdf.file_lines(files), "Window") == 0


def test_lines_and_cells_are_those_of_the_places(spark):
    rng, rows = random.Random(2), []
    for page in range(30):
        for run in range(rng.choice([1, 2, 40])):
            x = rng.choice([0.0, 5.0, 8.5, 30.0, 90.0, -4.0])
            rows.append((f"p{page % 3}", page, run, x, rng.choice([0.0, -0.0, 3.0, 3.5, 20.0, 23.0, 26.0, 40.0]), x + rng.choice([0.0, 2.0, 22.0, 200.0]), rng.choice([1.0, 10.0]), rng.choice(["a", "b c", "d\ne", " \t", "f"])))
    want = []
    for page in {(r[0], r[1]) for r in rows}:
        line, above, lines = 0, None, {}
        for r in sorted((r for r in rows if r[:2] == page), key=lambda r: (-r[4], r[3], r[2])):
            line, above = line + (above is not None and above - r[4] > pdf.LINE_TOLERANCE), r[4]
            lines.setdefault(line, []).append(r)
        for line, held in lines.items():
            text, reach = "", None
            for r in sorted(held, key=lambda r: (r[3], r[2])):
                gap = -1 if reach is None else r[3] - reach
                text += ("\n" if gap > 2 * r[6] else " " if gap > pdf.WORD_TOLERANCE else "") + r[7].replace("\n", " ")
                reach = r[5] if reach is None else max(reach, r[5])
            if cells := [c for c in (" ".join(c.split()) for c in text.split("\n")) if c]:
                want.append((*page, line, " ".join(cells), cells))
    runs = spark.createDataFrame(rows, "path string, page int, run int, x double, y double, x_end double, size double, text string").withColumn("error", F.lit(None).cast("string")).repartition(5)
    assert sorted(tuple(r) for r in pdf.page_lines(runs).collect()) == sorted(want)


def test_strings_set_by_themselves_are_read_as_one_by_one(monkeypatch):
    put = b"1 0 0 1 %d 700 Tm (w%d) Tj\n"
    contents = [
        b"BT /F 10 Tf " + b"".join(put % (k * 9, k) for k in range(50)) + b"(after) Tj 0 -20 Td (below) Tj ET",
        b"BT /F 10 Tf 2 .5 -.5 2. +7 7 Tm (turned\\(1\\)) Tj\n2 .5 -.5 2. 7 8 Tm <4a4B> Tj 1 0 0 1 1.2.3 5 Tm (odd) Tj 1 0 0 1 - 5 Tm (none) Tj 1 0 0 1 5 5 Tm ( ) Tj (x) Tj ET",
        b"q .5 0 0 3 10 20 cm BT 4 Ts 1 Tc 2 Tw 50 Tz /F 10 Tf 1 0 0 1 0 9 Tm (a b) Tj 0 1 -1 0 3 9 Tm (c\\\\) Tj 9 Tc 1 0 0 1 0 5 Tm (d) Tj T* (e) Tj ET Q BT 1 0 0 1 0 9 Tm (f)Tj 1 0 0 1 0 8 Tm(g(h))Tj 1 0 0 1 0 8 Tm(\\101)Tj 1 0 0 1 0 8 Tm <4> Tj 1 0 0 1 9 8 Tm (i)TjX 1 0 0 1 9 8 Tm (j) Tj ET",
        b"BT 1 0 0 1 0 9 Tm (no font) Tj /None 9 Tf 1 0 0 1 0 9 Tm (nor here) Tj /F 9 Tf 1 0 0 1 0 9 Tm (but here) Tj 3 1 0 0 1 0 9 Tm (k) Tj [(l)] TJ ET",
    ]
    files = [one_page(c) for c in contents]
    quick = [pdf.file_runs(f) for f in files]
    monkeypatch.setattr(pdf, "_SET", NEVER)
    assert quick == [pdf.file_runs(f) for f in files] and [len(r) for r, _ in quick][0] == 52
    assert [r[6] for r in quick[1][0]][:2] == ["turned(1)", "JK"] and [r[6] for r in quick[3][0]] == ["but here", "k", "l"]


def test_what_files_share_does_not_mix_them_up(monkeypatch):
    content = b"BT /F 10 Tf 0 700 Td (AB) Tj 40 0 Td (endobj A) Tj ET"
    named = lambda code, text: b"<< /Type /Font /Subtype /Type1 /Widths [%d 900] /FirstChar 65 /Encoding << /Differences [65 /%s] >> >>" % (code, text)
    fonts = [named(500, b"X"), named(500, b"Y"), named(700, b"X"), b"<< /Subtype /TrueType /Note (endobj) /Widths 7 0 R /FirstChar 65 >>", b"<< /Subtype /TrueType /Widths [500"]
    files = [one_page(content, f, (b"<< >>", b""), more) for f in fonts for more in (b"[100 200]", b"[300 400]")]
    monkeypatch.setattr(pdf, "OBJECTS", 0)
    monkeypatch.setattr(pdf, "FONTS", 0)
    apart = []
    for f in files:
        pdf._objects.clear()
        pdf._fonts.clear()
        apart.append(pdf.file_runs(f))
    monkeypatch.undo()
    assert [pdf.file_runs(f) for f in files + files] == apart + apart
    assert len({repr(r) for r in apart[:8]}) == 5


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    for name, most in (("FONTS", 3), ("SIZES", 2), ("STRINGS", 10), ("OBJECTS", 5)):
        monkeypatch.setattr(pdf, name, most)
    for k in range(40):
        text = "\n".join(f"w{k}-{j}" for j in range(60))
        runs, wrong = pdf.file_runs(one_page(b"BT /F 10 Tf 0 700 Td (x) Tj %d Tc " % k + b" ".join(b"1 0 0 1 0 %d Tm (%s) Tj" % (j, w.encode()) for j, w in enumerate(text.split())) + b" ET", b"<< /Subtype /Type1 /N %d >>" % (k % 7)))
        assert wrong is None and [r[6] for r in runs][1:] == text.split()
    assert len(pdf._fonts) <= 3 and len(pdf._objects) <= 5
    assert all(len(f.strings) <= 10 and len(f.set) <= 2 and all(len(h) <= 70 for h in f.set.values()) for f in pdf._fonts.values())


def test_tidy_text_is_told_without_a_pattern(spark):
    blanks = [c + d for c in ("", "a", *s.BLANKS) for d in ("", "a", *s.BLANKS)]
    texts = spark.createDataFrame([(b + "x" * k + c,) for b in blanks for k in (0, 1) for c in ("", "y", " ")] + [("a b c",), ("a\u200bb",), ("é",), (None,)], "t string")
    changed = F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    assert texts.filter(changed != s.collapse("t")).count() == 0
    assert texts.filter((changed != F.col("t")) & ~s.untidy("t")).count() == 0 and texts.filter(~s.untidy("t")).count() > 3
