"""PDF files of texts, for queries and tests that read them back."""

from __future__ import annotations

import functools
import random
import zlib

from pyspark.sql import DataFrame

PER_PAGE = 40
JUMPS = (-0.5, 0, 0.5)
HEIGHTS = [[f"{760 - 15 * row + jump} Tm " for jump in JUMPS] for row in range(PER_PAGE)]


def _stream(data: bytes, more: str = "") -> bytes:
    return f"<< /Length {len(data)} {more}>>\nstream\n".encode() + data + b"\nendstream"


@functools.lru_cache(4096)
def _two_byte(letters: str) -> tuple[dict[str, str], bytes]:
    """Codes of two bytes for the letters, in hexadecimal digits, and the stream of their ToUnicode map."""
    wide = {c: f"{k:04x}" for k, c in enumerate(letters, 1)}
    ranges = "".join([f"<{code}> <{c.encode('utf-16-be').hex()}>\n" for c, code in wide.items()])
    # a cut-down map: one block of pairs, as long as there are letters
    return wide, _stream(f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(letters)} beginbfchar\n{ranges}endbfchar".encode())


def pdf_file(text: str, seed: int = 0) -> bytes:
    """A PDF file with the lines of ``text``, each word set by itself, in an order that is not that of reading.

    Base lines jump by up to a unit within a line, as those of other fonts do. Every other page has
    a font of two-byte codes that only its ToUnicode map explains.
    """
    rng, lines = random.Random(seed), text.splitlines()
    pages = [lines[k : k + PER_PAGE] for k in range(0, len(lines), PER_PAGE)] or [[]]
    wide, cmap = _two_byte("".join(sorted(set("".join(lines)))))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    objects += [b"<< /Type /Font /Subtype /Type0 /BaseFont /Mono /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 6 0 R >>", b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Mono /DW 600 >>", cmap]
    kids, drawn = [], rng.random
    for number, page in enumerate(pages):
        shows = []
        for row, line in enumerate(page):
            at, words = 30, line.split(" ")
            if number % 2:
                shown = ["<" + "".join([wide[c] for c in word]) + ">" for word in words]
            else:
                shown = [f"({word})" for word in line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").split(" ")]
            for word, base, codes in zip(words, rng.choices(HEIGHTS[row], k=len(words)), shown, strict=True):
                if word:
                    shows.append(f"1 0 0 1 {at} {base}{codes} Tj")
                at += 6 * len(word) + 6
        shows.sort(key=lambda _: drawn())
        content = f"BT /F{number % 2} 10 Tf\n".encode() + "\n".join(shows).encode("cp1252", "replace") + b"\nET"
        kids.append(len(objects) + 1)
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 900 800] /Resources << /Font << /F0 3 0 R /F1 4 0 R >> >> /Contents {len(objects) + 2} 0 R >>".encode()]
        objects += [_stream(zlib.compress(content, 1), "/Filter /FlateDecode ")]
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join([f'{k} 0 R' for k in kids])}] >>".encode()
    return b"%PDF-1.5\n" + b"".join([f"{k} 0 obj\n".encode() + o + b"\nendobj\n" for k, o in enumerate(objects, 1)]) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def pdf_files(texts: DataFrame) -> DataFrame:
    """(path, content) of the texts (path, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [pdf_file(text or "", len(text or "")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: texts are small, making and reading files of them isn't
    return texts.select("path", "text").repartition(parts, "path").mapInArrow(run, "path string, content binary")
