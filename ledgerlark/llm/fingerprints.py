"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch adds each digest to one cell in each of three rows of cells: a count, the exclusive-or of
the digests and of their checks. Subtracting two versions' sketches cancels what they share;
peeling cells that hold one digest recovers the digests in which they differ. If peeling stops
early, both versions are sketched with eight times the cells.

What is returned as a fingerprint is the smallest sketch, of CELLS cells, which peels for some
dozen differences. The likeness of two versions comes from sketches of as many cells as their
difference takes, whose number is returned beside it; larger sketches are not returned, as they
would grow with the texts.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ledgerlark.llm.common import documents, mix64, small_batches
from ledgerlark.llm.ordering import successive, with_successors

ROWS = 3
CELLS = 24
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited long, cells_next long"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = pd.util.hash_array(np.array(["", None], dtype=object)[:-1], categorize=False)[0]
_SHIFTS, _LOW = np.arange(0, 21 * ROWS, 21, dtype=np.uint64)[:, None], np.uint64((1 << 21) - 1)


class Words:
    """A text's words, parted by blanks and line ends: their hashes, and which are the last of a line."""

    def __init__(self, hashed: np.ndarray, ends: np.ndarray):
        self.hashed, self.ends = hashed, ends

    @classmethod
    def of(cls, text: str) -> Words:
        ends = np.cumsum([line.count(" ") + 1 for line in text.split("\n")])
        out = cls(_hashed(text.replace("\n", " ").split(" ")), np.zeros(ends[-1], bool))
        out.ends[ends - 1] = True
        return out

    def edited(self, head: str, after: Words, tail: str) -> Words:
        """The words of ``head + tail``, the starts of this text and of ``after``'s: only words that are cut are hashed anew."""
        n, m = (x.count(" ") + x.count("\n") for x in (head, tail))
        cut = _last(head) + tail.replace("\n", " ", 1).split(" ", 1)[0]
        if not m:
            return Words(np.append(self.hashed[:n], _hashed([cut])), np.append(self.ends[:n], True))
        hashed = _hashed([cut, _last(tail)])
        return Words(np.concatenate([self.hashed[:n], hashed[:1], after.hashed[1:m], hashed[1:]]), np.concatenate([self.ends[:n], after.ends[:m], [True]]))


def _last(text: str) -> str:
    """What follows the last blank or line end."""
    return text[max(text.rfind(" "), text.rfind("\n")) + 1 :]


def _hashed(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array([*words, None], dtype=object)[:-1], categorize=False)


def paragraph_digests(text: str | Words, words: int = 8) -> np.ndarray:
    """A 64-bit digest of each paragraph: a line, or where it has more than ``words`` blank-separated words the runs of them that end with a word whose hash ``words`` divides.

    As the words themselves say where a run ends, one put in or taken out changes one run or two
    and no other. The k-th of equal paragraphs has a digest of its own, so the digests are a set.
    """
    own = Words.of(text) if isinstance(text, str) else text
    hashed, ends = own.hashed, np.flatnonzero(own.ends) + 1
    sizes = ends - np.concatenate([[0], ends[:-1]])
    last = np.repeat(sizes > words, sizes) & (hashed % np.uint64(words) == 0)
    last |= own.ends
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    place = np.arange(1, len(hashed) + 1) - np.repeat(starts, lengths)
    digests = np.add.reduceat(mix64(hashed + place.astype(np.uint64) * _GOLDEN), starts)
    digests = np.sort(digests[(lengths > 1) | (hashed[starts] != _EMPTY)])
    new = digests[1:] != digests[:-1]
    if new.all():
        return mix64(digests)
    firsts = np.flatnonzero(np.concatenate([[True], new]))
    rank = np.arange(len(digests)) - np.repeat(firsts, np.diff(np.append(firsts, len(digests))))
    return mix64(digests + rank.astype(np.uint64) * _GOLDEN)


def _checks(digests: np.ndarray) -> np.ndarray:
    return mix64(digests ^ _GOLDEN)


def _cells(checks: np.ndarray, cells: int) -> np.ndarray:
    """The cells, one in each of ROWS rows, of digests with these checks: 21 bits of the check for each row."""
    row = cells // ROWS
    return ((checks >> _SHIFTS & _LOW) % np.uint64(row)).astype(np.int64) + np.arange(0, cells, row)[:, None]


class Sketch:
    """Cells of counts, exclusive-ors of digests and exclusive-ors of checks."""

    def __init__(self, counts: np.ndarray, keys: np.ndarray, checks: np.ndarray):
        self.counts, self.keys, self.checks = counts, keys, checks

    @classmethod
    def of(cls, digests: np.ndarray, cells: int, checks: np.ndarray | None = None) -> Sketch:
        out = cls(np.zeros(cells, np.int32), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64))
        out.add(digests, np.ones(len(digests), np.int32), _checks(digests) if checks is None else checks)
        return out

    def add(self, digests: np.ndarray, signs, checks: np.ndarray) -> None:
        at = _cells(checks, len(self.counts)).ravel()
        np.add.at(self.counts, at, np.concatenate([signs] * ROWS))
        np.bitwise_xor.at(self.keys, at, np.concatenate([digests] * ROWS))
        np.bitwise_xor.at(self.checks, at, np.concatenate([checks] * ROWS))

    def minus(self, other: Sketch) -> Sketch:
        return Sketch(self.counts - other.counts, self.keys ^ other.keys, self.checks ^ other.checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests that only the first and only the second version has; None if some stay tangled."""
        found, signs = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        while True:
            single = np.flatnonzero(np.abs(self.counts) == 1)
            pure = single[self.checks[single] == _checks(self.keys[single])]
            if not len(pure):
                break
            order = np.argsort(self.keys[pure], kind="stable")
            digests = self.keys[pure[order]]
            pure = pure[order[np.concatenate([[True], digests[1:] != digests[:-1]])]]  # each digest once
            digests, own = self.keys[pure], self.counts[pure]
            found.append(digests)
            signs.append(own)
            self.add(digests, -own, self.checks[pure])
        if self.counts.any() or self.keys.any():
            return None
        digests, own = np.concatenate(found), np.concatenate(signs)
        return digests[own > 0], digests[own < 0]

    def text(self) -> str:
        """All cells, as base64 of little-endian numbers."""
        return base64.b64encode(self.counts.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u8").tobytes()).decode()


class Version:
    """A text's digests, and its sketches of every size asked for so far."""

    def __init__(self, digests: np.ndarray):
        self.digests, self.checks, self.sketches = digests, _checks(digests), {}

    def sketch(self, cells: int) -> Sketch:
        if cells not in self.sketches:
            self.sketches[cells] = Sketch.of(self.digests, cells, self.checks)
        return self.sketches[cells]


def _described(text: str) -> tuple[Words, Version]:
    words = Words.of(text)
    return words, Version(paragraph_digests(words))


def differing(a: Version, b: Version, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, int]:
    """The digests that only ``a`` and only ``b`` has, from sketches of ``cells`` cells and then eight times as many until they peel, and the number of cells that did.

    Sketches with fewer cells than the versions' numbers of digests differ by cannot peel, and are passed over.
    """
    while True:
        if cells >= abs(len(a.digests) - len(b.digests)):
            found = a.sketch(cells).minus(b.sketch(cells)).peel()
            if found is not None:
                return *found, cells
        cells *= 8


def likeness(a: Version, b: Version) -> tuple[float, int]:
    """Twice the shared digests over all digests of two versions, 0 to 1 (1 if neither has any), and the number of cells that it took."""
    total = len(a.digests) + len(b.digests)
    if not total:
        return 1.0, CELLS
    only_a, only_b, cells = differing(a, b)
    return (total - len(only_a) - len(only_b)) / total, cells


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, and the numbers of cells that these two took.

    The edited text has its last quarter (floor of n_chars / 4 code points) replaced by as many
    code points of the head of the next document in doc_id order, or all that it has; the document
    after the last is the first. A fingerprint is the sketch with 24 cells, so equal texts have
    equal ones; likeness comes from sketches as large as recovering the difference takes.

    Null texts are empty; very long ones are sketched whole. Null doc_ids come first, and rows with
    equal doc_ids follow each other by a hash of the text; every row gives one row, and a table of
    one row is its own next. An empty table gives none. Other columns, whatever their names, are
    not read. The texts are shuffled once.
    """

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        rows, last = [], (None, None, None)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            return out

        for doc_id, text, after in successive(batches):
            text, after = text or "", after or ""
            quarter = len(text) // 4
            edited = text[: len(text) - quarter] + after[:quarter]
            words, own = last[1:] if last[0] == text else _described(text)
            words_after, following = _described(after)
            changed = Version(paragraph_digests(words.edited(text[: len(text) - quarter], words_after, after[:quarter])))
            last = after, words_after, following
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            (near_edited, cells_edited), (near_next, cells_next) = likeness(own, changed), likeness(own, following)
            rows.append((doc_id, len(text), sha, own.sketch(CELLS).text(), changed.sketch(CELLS).text(), near_edited, near_next, cells_edited, cells_next))
            if len(rows) >= 2000:
                yield flush()
        if rows:
            yield flush()

    return with_successors(small_batches(docs)).mapInArrow(run, SCHEMA)


def op5_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(documents(spark, sf_dir))
