"""Rows of the tables in HTML pages, as a table function: SQL has no parser for HTML that isn't XML."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: A plain tag, an end or a start with attributes, and the text after it.
_PLAIN = re.compile(r"""<(?:/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*|([a-zA-Z][a-zA-Z0-9]*)(?:[ \t\n\r\f]+[a-zA-Z_:][-a-zA-Z0-9_:.]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^ \t\n\r\f"'<>=`/&]+))?)*[ \t\n\r\f]*)>([^<]*)""")
#: Elements whose content has no tags, or not all of them.
_RAW = {"script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript", "svg", "math"}


class _Rows(HTMLParser):
    """Collects (table, row, cells); cells with collapsed blanks, rows without cells left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, int, list[str]]] = []
        self.table, self.rows, self.cells, self.words = -1, 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.rows = self.table + 1, 0
        elif tag == "tr":
            self._row()
            self.cells = []
        elif tag in ("td", "th"):
            self._cell()
            self.words = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._cell()
        elif tag in ("tr", "table"):
            self._row()

    def handle_data(self, data):
        if self.words is not None:
            self.words.append(data)

    def _cell(self):
        if self.words is not None and self.cells is not None:
            self.cells.append(" ".join("".join(self.words).split()))
        self.words = None

    def _row(self):
        self._cell()
        if self.cells and self.table >= 0:
            self.found.append((self.table, self.rows, self.cells))
            self.rows += 1
        self.cells = None


def _plain_rows(html: str) -> list[tuple[int, int, list[str]]] | None:
    """What _Rows finds in a page of nothing but plain tags and texts; None of other pages."""
    parts = _PLAIN.split(html)
    if "<" in parts[0] or any(parts[4::4]):
        return None
    rows = _Rows()
    for end, start, text in zip(parts[1::4], parts[2::4], parts[3::4], strict=True):
        tag = (start or end).lower()
        if start:
            if tag in _RAW:
                return None
            rows.handle_starttag(tag, ())
        else:
            rows.handle_endtag(tag)
        if text and rows.words is not None:
            rows.words.append(unescape(text) if "&" in text else text)
    rows._row()
    return rows.found


def table_rows(html: str | None) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of a page; the parser proper reads only pages with comments, scripts or damaged tags."""
    if (found := _plain_rows(html or "")) is not None:
        return found
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    parser._row()
    return parser.found


def html_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells) of every table row of every page; a null page has none. Pages are parsed in Arrow batches."""
    schema = StructType([pages.schema[key], *StructType.fromDDL("table_no int, row_no int, cells array<string>")])

    def run(batches):
        import pyarrow as pa

        types = [pa.int32(), pa.int32(), pa.list_(pa.string())]
        for batch in batches:
            found = [table_rows(text) for text in batch.column(1).to_pylist()]
            at = pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64())
            columns = list(zip(*(row for rows in found for row in rows), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return pages.select(key, html).mapInArrow(run, schema)
