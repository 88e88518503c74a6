"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, run once over each text.

Texts are normalised to words between single spaces. The automaton holds every window of ``width``
consecutive words of the items, so one walk over a normalised text finds all of them; where a
window ends there is mapped back to words, and to code points of the text as it was.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, mark, numbered, release, saved, slices, small_batches
from ledgerlark.llm.licenses import license_words

#: Of a text: its words, the disjoint runs of hit words (places from 0, code points of the original, ends exclusive), and the items whose windows occur.
FOUND = "n_words long, runs array<struct<first: int, last: int, start: int, end: int>>, items array<string>"
#: The same words as license_words() finds, in a text that still has its capitals.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: 40 bytes for each character of a window, some 56: an automaton of so many windows has about 110 MB.
MOST_WINDOWS = 50_000


def item_windows(benchmark: DataFrame, columns: tuple[str, ...], item: str, width: int) -> DataFrame:
    """The distinct (window, item): runs of ``width`` words of each of an item's ``columns``; of a text with fewer words, all of them."""

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches):
            windows, items = [], []
            for key, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for words in map(license_words, texts):
                    k = min(width, len(words))
                    found = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else ()
                    windows += found
                    items += [key] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(items, pa.string())], names=["window", "item"])

    return benchmark.select(F.col(item).cast("string"), *columns).mapInArrow(cut, "window binary, item string").distinct()


class Automaton:
    """The windows of test items, found in a text in one walk."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        import ahocorasick

        items = defaultdict(list)
        for window, item in pairs:
            items[window].append(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for window, of in items.items():
            # one character a byte: the trie is as wide as a byte, whatever the language
            self.trie.add_word((b" %b " % window).decode("latin-1"), (window.count(b" ") + 1, of))
        self.trie.make_automaton()
        self.empty = not items

    def hits(self, text: str | None) -> bool:
        """Whether a window stands in the text."""
        words = () if self.empty else license_words(text)
        return bool(words) and next(self.trie.iter((b" %b " % b" ".join(words)).decode("latin-1")), None) is not None

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """A row of FOUND."""
        words = license_words(text)
        if self.empty or not words:
            return len(words), [], []
        hits, items = [], set()
        for end, (k, of) in self.trie.iter((b" %b " % b" ".join(words)).decode("latin-1")):
            hits.append((end, k))
            items.update(of)
        if not hits:
            return len(words), [], []
        ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word stands
        last = np.searchsorted(ends, [end for end, _ in hits]) + 1
        where = [m.span() for m in _WORD.finditer(text)]
        runs = joined(zip((last - [k for _, k in hits]).tolist(), last.tolist(), strict=True))
        return len(words), [(a, b, where[a][0], where[b - 1][1]) for a, b in runs], sorted(i for i in items if i is not None)


def joined(spans) -> list[tuple[int, int]]:
    """The disjoint runs that spans (first, last), ends exclusive, cover together."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def _scanned(rows: DataFrame, key: str, pairs) -> DataFrame:
    """FOUND of each row of ``rows`` (key, text) with the windows in the broadcast ``pairs``."""

    def run(batches):
        import pyarrow as pa

        automaton = Automaton(pairs.value)
        kinds = [pa.int64(), pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")])), pa.list_(pa.string())]
        for batch in slices(batches):
            n, runs, items = zip(*map(automaton.scan, batch.column(1).to_pylist()), strict=True)
            runs = [[dict(zip(("first", "last", "start", "end"), r, strict=True)) for r in x] for x in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip((n, runs, items), kinds, strict=True))], names=[key, "n_words", "runs", "items"])

    return rows.mapInArrow(run, f"{key} long, {FOUND}")


def _merged(rows: DataFrame) -> DataFrame:
    """One row per (row, doc_id, n_words) of what several automata found in the same text: runs that overlap or touch become one."""
    whole = rows.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    head = lambda out: F.element_at(out, -1)
    longer = lambda out, r: F.struct(head(out)["first"].alias("first"), F.greatest(head(out)["last"], r["last"]).alias("last"), head(out)["start"].alias("start"), F.greatest(head(out)["end"], r["end"]).alias("end"))
    add = lambda out, r: F.when((F.size(out) > 0) & (r["first"] <= F.try_element_at(out, F.lit(-1))["last"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer(out, r)))).otherwise(F.concat(out, F.array(r)))
    empty = F.slice("runs", 1, 0)
    return whole.withColumn("runs", F.when(F.size("runs") == 0, F.col("runs")).otherwise(F.aggregate("runs", empty, add)))


def _broadcast(benchmark: DataFrame, columns: tuple[str, ...], item: str, width: int, most: int) -> list:
    """The distinct (window, item) as broadcasts of about ``most`` each, dealt by hash."""
    began, spark = mark(), benchmark.sparkSession
    pairs = saved(item_windows(benchmark, columns, item, width), "item-windows")
    parts = max(1, -(-pairs.count() // most))
    part = F.pmod(F.xxhash64("window", "item"), F.lit(parts))
    held = [spark.sparkContext.broadcast([tuple(r) for r in pairs.filter(part == k).collect()]) for k in range(parts)]
    release(spark, began)
    return held


def contamination(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("text",), item: str = "item_id", width: int = 10, most: int = MOST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, runs of hit words (``runs``) and ``items``, the item ids (as sorted strings) with a window in it.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z lower-cased. Each of an
    item's ``columns`` (its question, its answer) is cut into windows of ``width`` words; one with
    fewer words, but not none, is a window itself. A run is where windows stand that overlap or
    touch: its words from ``first`` to before ``last``, and the code points of the text as it was.

    Null and empty texts have no words and are not hit; null and empty items have no windows.
    Windows of an item with a null id hit words but name no item. Repeated documents each give a
    row, repeated items count once. Very long texts are walked whole. An empty table of documents
    gives no rows, an empty benchmark hits nothing. Columns that are not named are not read.

    Texts are not shuffled: the automaton of up to ``most`` windows goes to each task. Of more
    windows, every part of so many has an automaton and a pass of its own over the texts, and what
    the passes found in a text is put together by row; so memory is bounded and no window is left out.
    """
    held = _broadcast(benchmark, columns, item, width, most)
    if len(held) == 1:
        return _scanned(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", held[0])
    rows = numbered(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row")
    found = functools.reduce(DataFrame.union, (_scanned(rows.select("row", "text"), "row", p) for p in held))
    return _merged(found.join(rows.select("row", "doc_id"), "row")).drop("row")


def decontaminated(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("text",), item: str = "item_id", width: int = 10, most: int = MOST_WINDOWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of the benchmark (see contamination()).

    Each row is judged by its own text, so rows of one doc_id may differ; null and empty texts
    stay. Nothing is shuffled. Where the windows need several automata, what one leaves is written
    before the next reads it.
    """
    held = _broadcast(benchmark, columns, item, width, most)

    def clean(pairs):
        @F.pandas_udf("boolean")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = Automaton(pairs.value)
            for texts in batches:
                yield pd.Series([not automaton.hits(t) for t in texts], dtype=bool)

        return of

    rows = small_batches(docs)
    for k, pairs in enumerate(held):
        rows = rows.filter(clean(pairs)("text"))
        if k + 1 < len(held):
            rows = saved(rows, "clean")
    return rows


def op13_decontamination(spark, sf_dir):
    """Words of all documents that stand in a 10-word window of a benchmark item."""
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same in DuckDB, by joining all windows of the texts with all windows of the items.
ORACLE = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
    i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
    k AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM i WHERE len(ws) > 0),
    own AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(0, len(ws) - k + 1), lambda p: array_to_string(ws[p + 1 : p + k], ' '))) AS win FROM k),
    lens AS (SELECT DISTINCT k FROM k),
    spot AS (SELECT rid, k, unnest(range(0, len(ws) - k + 1)) AS p, ws FROM d, lens WHERE len(ws) >= k),
    hit AS (SELECT rid, p, w.k, item_id FROM (SELECT rid, k, p, array_to_string(ws[p + 1 : p + k], ' ') AS win FROM spot) w JOIN own ON own.k = w.k AND own.win = w.win),
    n AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + k)) AS w FROM hit) GROUP BY rid),
    m AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
