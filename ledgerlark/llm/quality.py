"""Quality rules: lines that many documents of a host repeat, and documents that are little else.

Each line is normalised and hashed; a line's frequency on a host is the number of distinct
documents that have it there. Lines above the limits go, and documents that lose most of their
words are rejected, as are documents that fail the base rules (too short, or repeating themselves).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ledgerlark.llm.common import documents, hash_words, mark, release, saved, slices, small_batches, trimmed, window_hashes, words_of

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
PROFILE = f"host string, digest binary, doc_id long, {MEASURES}, version long, lines array<struct<hash:long,words:int>>"
SYMBOLS = re.compile(rb"[#*$%&|<>]")


def line_digest(words: list[bytes]) -> bytes:
    """The MD5 digest of a line's words, A-Z lower-cased and one blank apart."""
    return hashlib.md5(b" ".join(words).lower(), usedforsecurity=False).digest()


def line_key(digest: bytes) -> int:
    """The 64 bits of a digest that stand for the line."""
    return int.from_bytes(digest[:8], "big", signed=True)


def line_digests(text: str) -> tuple[list[str], list[bytes], list[int]]:
    """The \\n-split lines with a word, their digests, and their numbers of words."""
    lines, keys, words = [], [], []
    for line in text.split("\n"):
        if own := words_of(line):
            lines.append(line)
            keys.append(line_digest(own))
            words.append(len(own))
    return lines, keys, words


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in windows of ``width`` words that the text has at least twice."""
    windows = window_hashes(hash_words(words), width)
    if not len(windows):
        return 0
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text, then its version and its lines as (hash, words)."""
    text = text or ""
    words = words_of(text)
    lines, digests, sizes = line_digests(text)
    chars = len(text) - sum(map(text.count, "\t\n\v\f\r "))
    base = len(words), chars, len(SYMBOLS.findall(text.encode("utf-8", "surrogatepass"))), len(lines) - len(set(lines)), repeated_words(words)
    if not digests:
        return *base, 0, []
    version = line_key(hashlib.md5(b"".join(sorted(set(digests))), usedforsecurity=False).digest())
    own: dict[int, int] = {}
    for digest, n in zip(digests, sizes, strict=True):
        own[line_key(digest)] = own.get(line_key(digest), 0) + n
    return *base, version, [{"hash": k, "words": n} for k, n in own.items()]


@dataclass(frozen=True)
class Limits:
    """When a line is common on a host, and when a document is kept; see line_frequency()."""

    min_docs: int = 20
    share: float = 0.05
    enough_docs: int = 1000
    keep_share: float = 0.3
    min_words: int = 50

    def failed(self, n_words, n_repeat_words):
        return (n_words < self.min_words) | (100 * n_repeat_words > 50 * n_words)


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _profiles(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        struct = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))
        for batch in slices(batches):
            columns = list(zip(*map(measure, batch.column(3).to_pylist()), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], struct)], names=["host", "digest", "doc_id", *(c.split()[0] for c in MEASURES.split(", ")), "version", "lines"])

    measured = small_batches(docs).select(_host().alias("host"), _digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), PROFILE)
    return saved(measured.withColumn("place", F.monotonically_increasing_id()), "line-profiles")


def _lines(profiles: DataFrame) -> DataFrame:
    exploded = profiles.select("place", "host", "digest", "version", F.explode("lines").alias("line"))
    return exploded.select("place", "host", "digest", "version", F.col("line.hash").alias("line"), F.col("line.words").alias("words"))


def _common(profiles: DataFrame, limits: Limits) -> DataFrame:
    """(host, line) of the lines above the limits."""
    hosts = profiles.filter(F.size("lines") > 0).select("host", "version").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    once = _lines(profiles).groupBy("host", "line", "version").agg(F.lit(1))
    frequent = once.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > limits.min_docs)
    above = (F.col("n_docs") > limits.share * F.col("host_docs")) | (F.col("n_docs") > limits.enough_docs)
    return frequent.join(hosts, "host").filter(above).select("host", "line")


def line_frequency(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008 - frozen
    """One row per document: doc_id, the measures, base_failed, removed_words and kept.

    A line (its lower-cased words) is common on a host when more distinct documents of the host
    have it than ``min_docs`` and than ``share`` of the host's documents; more than ``enough_docs``
    of them suffice whatever the share, so the limit does not grow with the host. Documents with
    the same set of lines are versions of one document and count once, so a group of copies does
    not make its own lines common; pages that differ in any line are distinct documents. A
    document is kept if it passes the base rules (``min_words`` words; at most half its words in
    repeated 3-word windows) and at least ``keep_share`` of its words are in other lines.

    Null texts are empty (and fail the base rules); a null source is the host "". Rows with null
    doc_ids and repeated rows each give a row (repeated ones with equal verdicts). An empty table
    gives none. Very long texts are measured whole, one at a time in their task. Columns other
    than doc_id, source and text are not read, whatever their names. Only hashes are shuffled, and
    counts are combined before they are.
    """
    profiles = _profiles(docs)
    removed = _lines(profiles).join(_common(profiles, limits), ["host", "line"], "left_semi").groupBy("place").agg(F.sum("words").alias("removed_words"))
    judged = profiles.drop("lines", "version", "host", "digest").join(removed, "place", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = limits.failed(F.col("n_words"), F.col("n_repeat_words"))
    enough = F.col("n_words") - F.col("removed_words") >= limits.keep_share * F.col("n_words")
    return judged.withColumns({"base_failed": failed, "kept": ~failed & enough}).drop("place")


def judge(text: str | None, common, limits: Limits) -> str | None:
    """``text`` without its lines whose keys are in ``common``; None if the document is rejected."""
    n_words, *_, repeated, _, lines = measure(text)
    if limits.failed(n_words, repeated):
        return None
    removed = {x["hash"]: x["words"] for x in lines if x["hash"] in common}
    if n_words - sum(removed.values()) < limits.keep_share * n_words:
        return None
    if not removed:
        return text
    return "\n".join(line for line in text.split("\n") if not (own := words_of(line)) or line_key(line_digest(own)) not in removed)


def clean_documents(docs: DataFrame, limits: Limits = Limits(), few: int = 200_000) -> DataFrame:  # noqa: B008 - frozen
    """The documents that line_frequency() keeps, with their common lines taken out of ``text`` (and ``n_chars`` counted anew if there is such a column); same columns as ``docs``.

    Each document is judged where its text is. Up to ``few`` common lines (some 20 MB in a worker)
    are broadcast, and no text is shuffled. Where there are more, each document's own ones are
    brought to it by host and digest of the text, for which texts are shuffled once.

    A document without common lines keeps its text as it is. Repeated rows stay repeated. Nulls,
    empty and very long texts and an empty table go as in line_frequency(); all other columns are
    passed through, whatever their names.
    """
    began = mark()
    profiles = _profiles(docs)
    common = saved(_common(profiles, limits), "common-lines")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), "text", _host().alias("host"))
    shared = None
    if common.count() <= few:
        of_host = common.groupBy("host").agg(F.collect_list("line").alias("lines")).collect()
        shared = docs.sparkSession.sparkContext.broadcast({r.host: frozenset(r.lines) for r in of_host})
        rows = rows.withColumn("own", F.lit(None).cast("array<bigint>"))
        release(docs.sparkSession, began)
    else:
        own = _lines(profiles).join(common, ["host", "line"], "left_semi").groupBy("host", "digest").agg(F.collect_set("line").alias("own"))
        rows = rows.withColumn("digest", _digest()).join(own, ["host", "digest"], "left").select("rest", "text", "host", "own")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            hosts, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            common = [shared.value.get(h, ()) for h in hosts] if shared else [frozenset(k or ()) for k in own]
            before = batch.column(1).to_pylist()
            after = [judge(t, c, limits) for t, c in zip(before, common, strict=True)]
            keep = pa.array([t is not None for t in after], pa.bool_())
            cut = pa.array([a is not b for a, b in zip(after, before, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(after, pa.string()).filter(keep), cut.filter(keep)], names=["rest", "text", "cut"])

    rest = StructType([docs.schema[c] for c in others])
    schema = StructType([StructField("rest", rest), StructField("text", StringType()), StructField("cut", BooleanType())])
    kept = rows.mapInArrow(trimmed(run), schema)
    columns = {c: F.col("rest").getField(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def op6_line_quality(spark, sf_dir):
    """The measures and verdict of every document."""
    verdicts = line_frequency(documents(spark, sf_dir))
    return verdicts.select("doc_id", *(c.split()[0] for c in MEASURES.split(", ")), "base_failed", "kept", "removed_words")


#: In DuckDB, with the lines themselves in place of their keys.
ORACLE = """
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    windows AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
    repeats AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
    covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeats) GROUP BY rid),
    lines AS (SELECT rid, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS own
              FROM (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d)),
    keyed AS (SELECT rid, host, line, len(own) AS k, array_to_string(own, ' ') AS key FROM lines WHERE len(own) > 0),
    doubled AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM keyed GROUP BY rid),
    versions AS (SELECT rid, host, md5(string_agg(DISTINCT md5(key), '' ORDER BY md5(key))) AS version FROM keyed GROUP BY rid, host),
    hosts AS (SELECT host, count(DISTINCT version) AS n FROM versions GROUP BY host),
    common AS (SELECT host, key FROM (SELECT k.host, k.key, count(DISTINCT version) AS n FROM keyed k JOIN versions v ON k.rid = v.rid GROUP BY k.host, k.key) f
               JOIN hosts h USING (host) WHERE f.n > 20 AND (f.n > CAST(0.05 AS DOUBLE) * h.n OR f.n > 1000)),
    removed AS (SELECT rid, sum(k) AS n FROM keyed JOIN common USING (host, key) GROUP BY rid),
    m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(doubled.n, 0) AS n_dup_lines,
            coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS removed_words
          FROM w LEFT JOIN covered USING (rid) LEFT JOIN doubled USING (rid) LEFT JOIN removed USING (rid)),
    j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
           CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT base_failed AND n_words - removed_words >= CAST(0.3 AS DOUBLE) * n_words AS kept, CAST(removed_words AS BIGINT) AS removed_words
    FROM j
"""
