"""License scans: a positional index of rare licence words, and phrases that a licence must hold.

The index maps each word of the licence templates to its places in them. A file looks up its own
licence words, those with the highest inverse document frequency first, until enough places of
every template that it can hold are covered; each place of such a word in the file and in a
template votes for one alignment of the two. An alignment with enough votes is verified word by
word, and accepted if the template's mandatory phrase stands within it.

Texts are read once. That pass writes, of each file that can hold some template, the places of its
licence words, and counts in how many files each licence word stands; the rest works on those.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, saved, slices, small_batches
from ledgerlark.llm.license_texts import TEMPLATES

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
#: A row is a file, with the places and numbers of its licence words if a template can be in it; or, with ``word`` 0 and more, in how many files of a task a licence word stands, with -1 how many they are.
SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, found binary, word int, n long"

#: Phrases and the labels that they give wherever they stand.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_SPLIT = bytes(b if b in _KEEP or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of a text with A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def places(words: list[bytes], phrase: list[bytes], start: int = 0, end: int | None = None) -> list[int]:
    """Where ``phrase`` stands in ``words[start:end]``."""
    end, found, at = len(words) if end is None else end, [], start
    while True:
        try:
            at = words.index(phrase[0], at, max(at, end - len(phrase) + 1))
        except ValueError:
            return found
        if words[at : at + len(phrase)] == phrase:
            found.append(at)
        at += 1


class TemplateIndex:
    """Postings (template, place) of every licence word, and the search for the templates in a file.

    An alignment with ``coverage`` of a template's n words in place has at most floor((1 - coverage)
    * n) places out of place. Those whose words the file lacks are among them, so a file that lacks
    more can't hold the template. Once its rarest words cover min_votes places more than may be
    out of place besides, any such alignment has min_votes of them: none is lost by looking up
    the rarest words alone.
    """

    def __init__(self, templates, min_votes: int, coverage: float):
        self.templates = [(label, license_words(phrase), license_words(text)) for label, phrase, text in templates]
        self.words = sorted({w for _, phrase, words in self.templates for w in (*phrase, *words)})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.min_votes = min_votes
        self.slack = [math.floor((1 - coverage) * len(words) + 1e-9) for _, _, words in self.templates]
        self.postings = defaultdict(list)
        for t, (_, _, words) in enumerate(self.templates):
            for place, w in enumerate(words):
                self.postings[w].append((t, place))
        self.times = [Counter(words) for _, _, words in self.templates]

    def possible(self, here: set[bytes]) -> dict[int, int]:
        """The templates that a file with the words ``here`` can hold, and how many of their places its rarest words must cover."""
        out = {}
        for t, (_, phrase, words) in enumerate(self.templates):
            if here.issuperset(phrase):
                lacking = sum(n for w, n in self.times[t].items() if w not in here)
                if lacking <= self.slack[t]:
                    out[t] = min(self.slack[t] - lacking + self.min_votes, len(words) - lacking)
        return out

    def scan(self, places: list[tuple[int, bytes]], idf: dict[bytes, float]) -> dict[str, float]:
        """The accepted labels of a file, given the places of its licence words, each with its best share of template words in place."""
        at = dict(places)
        where = defaultdict(list)
        for i, w in places:
            where[w].append(i)
        wanted = self.possible(set(where))
        uncovered, votes = dict(wanted), Counter()
        for w in sorted(where, key=lambda w: (-idf[w], w)):
            if not uncovered:
                break
            for t, place in self.postings[w]:
                if t in wanted:
                    votes.update((t, i - place) for i in where[w])
                    if t in uncovered:
                        uncovered[t] -= 1
            uncovered = {t: n for t, n in uncovered.items() if n > 0}
        accepted: dict[str, float] = {}
        for (t, shift), n in votes.items():
            label, phrase, template = self.templates[t]
            if n < min(self.min_votes, len(template) - self.slack[t]):
                continue
            inside = sum(at.get(shift + k) == w for k, w in enumerate(template))
            if inside >= len(template) - self.slack[t] and any(all(at.get(shift + k + j) == w for j, w in enumerate(phrase)) for k in range(len(template) - len(phrase) + 1)):
                accepted[label] = max(inside / len(template), accepted.get(label, 0.0))
        return accepted


def license_scan(docs: DataFrame, templates=TEMPLATES, min_votes: int = 3, coverage: float = 0.7) -> DataFrame:
    """One row per document: doc_id, n_words, the base phrases' places, base_labels, labels and score.

    An alignment with ``coverage`` of a template's words in place, found by ``min_votes`` votes of
    the file's rarest licence words, gives the template's label if its mandatory phrase stands
    within it. Labels of base phrases are always given. ``score`` is the best share of template
    words in place among accepted alignments; for a file with nothing but a base phrase, 0.5;
    without labels, 0.

    Null and empty texts have no words; very long ones are read whole. Every row gives one row,
    null doc_ids and repeated rows too; an empty table gives none. Words in as many files as
    others go by the word. Other columns, whatever their names, are not read. Nothing is shuffled
    but the counts of the licence words, which are the only thing that the driver gets.
    """
    index = TemplateIndex(templates, min_votes, coverage)
    phrases = [(license_words(p), label) for p, label in BASE_PHRASES.items()]
    known = frozenset(index.words)
    scanned_names, names = ([c.split()[0] for c in x.split(", ")] for x in (SCANNED, SCHEMA))

    def read(batches):
        import pyarrow as pa

        types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.int32(), pa.int64()]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names=scanned_names)
        files, seen = 0, Counter()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = license_words(text)
                base = {label: places(words, p) for p, label in phrases}
                starts = [at for found in base.values() for at in found]
                here = known.intersection(words)
                files += 1
                seen.update(here)
                found = b""
                if index.possible(here):
                    found = np.array([(i, index.number[w]) for i, w in enumerate(words) if w in here], "<i4").tobytes()
                rows.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(label for label, x in base.items() if x)), found, None, None))
            yield table(rows)
        yield table([*((*[None] * 7, index.number[w], n) for w, n in seen.items()), (*[None] * 7, -1, files)])

    rows = saved(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, SCANNED), "license-places")
    counts = {r.word: r.n for r in rows.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    idf = {w: math.log((1 + counts.get(-1, 0)) / (1 + counts.get(k, 0))) for w, k in index.number.items()}

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            labels, scores = [], []
            for base, found in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                own = base.split(",") if base else []
                scanned = index.scan([(i, index.words[k]) for i, k in np.frombuffer(found, "<i4").reshape(-1, 2).tolist()], idf) if found else {}
                labels.append(",".join(sorted({*own, *scanned})))
                scores.append(max(scanned.values(), default=0.5 if own else 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=names)

    return rows.filter("word IS NULL").drop("word", "n").mapInArrow(run, SCHEMA)


def op9_license_scan(spark, sf_dir):
    """Licence phrases and labels of all documents."""
    return license_scan(documents(spark, sf_dir))


def oracle_sql(templates=TEMPLATES, coverage: float = 0.7) -> str:
    """The same in DuckDB: every template at every place, without an index."""
    listed = lambda text: "[" + ", ".join(f"'{w.decode()}'" for w in license_words(text)) + "]"
    notices = ", ".join(f"({t}, '{label}', {listed(phrase)}, {listed(text)})" for t, (label, phrase, text) in enumerate(templates))
    bases = ", ".join(f"('{label}', {listed(phrase)})" for phrase, label in BASE_PHRASES.items())
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    w AS (SELECT rid, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM d),
    notice AS (SELECT * FROM (VALUES {notices}) n(t, label, phrase, words)),
    base AS (SELECT * FROM (VALUES {bases}) b(label, phrase)),
    base_word AS (SELECT label, len(phrase) AS k, generate_subscripts(phrase, 1) - 1 AS place, unnest(phrase) AS word FROM base),
    base_place AS (SELECT rid, label, pos - place AS start FROM w JOIN base_word USING (word) GROUP BY rid, label, pos - place HAVING count(*) = any_value(k)),
    notice_word AS (SELECT t, len(words) AS k, generate_subscripts(words, 1) - 1 AS place, unnest(words) AS word FROM notice),
    aligned AS (SELECT rid, t, pos - place AS shift, any_value(k) AS k, count(*) / CAST(any_value(k) AS DOUBLE) AS share FROM w JOIN notice_word USING (word) GROUP BY rid, t, pos - place HAVING share >= CAST({coverage} AS DOUBLE)),
    phrase_word AS (SELECT t, len(phrase) AS k, generate_subscripts(phrase, 1) - 1 AS place, unnest(phrase) AS word FROM notice),
    phrase_place AS (SELECT rid, t, pos - place AS start, any_value(k) AS k FROM w JOIN phrase_word USING (word) GROUP BY rid, t, pos - place HAVING count(*) = any_value(k)),
    accepted AS (SELECT a.rid, n.label, max(a.share) AS share FROM aligned a JOIN phrase_place p ON p.rid = a.rid AND p.t = a.t AND p.start >= a.shift AND p.start + p.k <= a.shift + a.k JOIN notice n ON n.t = a.t GROUP BY a.rid, n.label),
    b AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base_place GROUP BY rid),
    l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base_place UNION SELECT rid, label FROM accepted) GROUP BY rid),
    s AS (SELECT rid, max(share) AS score FROM accepted GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(score, CASE WHEN n_base > 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END) AS score
    FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
    """
