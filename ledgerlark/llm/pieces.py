"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The pieces of a byte-pair model are the one path through the lattice of vocabulary pieces whose
neighbours are all compatible: two pieces are if merging their joined text gives the two again.
With weight 0 for a compatible step and minus infinity for any other, encoding is a best path in
the max-plus semiring. A giant document is cut into chunks anywhere. The states at a cut are the
pieces that may hold the character before it; a chunk's transfer matrix says which states at its
end each state at its start can reach. Matrices are multiplied, which is associative, by stretches
of FAN neighbours, and their products again, until FAN or fewer are left of a document; then the
states at the ends of each stretch settle those within it, level by level, which leaves one state
at every cut, and each chunk finds its own part of the path. So no task holds more than FAN
matrices of a document at a time, however long it is.

As all weights are 0 or minus infinity, a row of a matrix is a set, held as the bits of a number.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, saved, slices, small_batches
from ledgerlark.llm.encoder import vocabulary_path

GIANT = 8_192
CHUNK = 4_096
FAN = 64
SHORT = 32
NONE = float("-inf")
MARK = "▁"
CHUNKS = "row long, doc_id long, chunk int, start long, n_chars long, text string"


#: Kinds of models by the number that their file gives; 1 if it gives none.
MODEL_TYPES = {1: "unigram", 2: "byte-pair", 3: "word", 4: "character"}


def _fields(message: bytes):
    """(number, value) of the fields of a protocol buffer: numbers, or the bytes of what has a length."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            length, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = message[at : at + length], at + length
        yield key >> 3, value


def model_type(proto: bytes) -> str:
    """What kind of model a SentencePiece file holds: its trainer's model_type."""
    found = [v for field, spec in _fields(proto) if field == 2 for k, v in _fields(spec) if k == 3]
    return MODEL_TYPES.get(found[-1] if found else 1, "unknown")


class PieceModel:
    """A SentencePiece byte-pair model with byte fallback: its vocabulary, and the lattice of a text.

    Runs and pairs met before are remembered, ``remember`` of each and as many of the generation
    before, which is where those in use are found again once a generation is full.
    """

    def __init__(self, path: str, remember: int = 250_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.library
        if (kind := model_type(m.serialized_model_proto())) != "byte-pair":
            raise ValueError(f"a byte-pair model is needed; {path} is a {kind} model")
        kinds = range(m.vocab_size())
        self.bytes = {int(m.id_to_piece(i)[1:-1], 16): i for i in kinds if m.is_byte(i)}
        self.ids = {m.id_to_piece(i): i for i in kinds if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.scores = {p: m.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.alone: dict[str, bool] = {}
        self.bigrams = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.starts_word = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.agree: dict[tuple[str, str], bool] = {}
        self.agree_before: dict[tuple[str, str], bool] = {}
        words = f"{MARK}+[^{MARK}]*|[^{MARK}]+" if self.starts_word else "(?s:.+)"
        self.words = re.compile(words)

    def normalize(self, text: str | None) -> str:
        """The text as the model reads it: blanks as word marks, one more before the text."""
        return self.library.normalize(text) if text else ""

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, again and again, the first of the best-scored pairs."""
        score, parts = self.scores.get, list(text)
        pairs = [score(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) != NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NONE)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NONE)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        if left[-1] + right[0] not in self.bigrams:
            return True
        found = self.agree.get((left, right))
        if found is None:
            found = self.agree_before.get((left, right))
            if found is None:
                found = self.merged(left + right) == [left, right]
            if len(self.agree) >= self.remember:
                self.agree, self.agree_before = {}, self.agree
            self.agree[left, right] = found
        return found

    def ends(self, text: str, start: int) -> list[int]:
        """Where pieces end that start at ``start``; a character that isn't a piece is one of its own."""
        out = [] if text[start] in self.ids else [start + 1]
        for end in range(start + 1, min(len(text), start + self.longest) + 1):
            piece = text[start:end]
            if piece not in self.prefixes:
                break
            if piece in self.ids:
                good = self.alone.get(piece)
                if good is None:
                    good = self.alone[piece] = self.merged(piece) == [piece]
                if good:
                    out.append(end)
        return out

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The (start, end) of the pieces that hold the character before ``cut``; at the text's start, the empty one."""
        if cut == 0:
            return [(0, 0)]
        return [(s, e) for s in range(max(0, cut - self.longest), cut) for e in self.ends(text, s) if e >= cut]

    def reach(self, text: str, first: dict[tuple[int, int], int], stop: int) -> dict[tuple[int, int], int]:
        """For each lattice piece after the ``first`` ones, and starting before ``stop``: the set of ``first`` ones (their bits) that reach it."""
        ending: dict[int, list[tuple[int, int]]] = {}
        for span in first:
            ending.setdefault(span[1], []).append(span)
        sets = dict(first)
        for start in range(min(ending), min(stop, len(text))):
            if start not in ending:
                continue
            lefts = [(None if s == e else text[s:e], sets[s, e]) for s, e in ending[start]]
            for end in self.ends(text, start):
                right, bits = text[start:end], 0
                for left, found in lefts:
                    if left is None or self.compatible(left, right):
                        bits |= found
                if bits:
                    sets[start, end] = bits
                    ending.setdefault(end, []).append((start, end))
        return sets

    def path(self, text: str, entry: tuple[int, int], last: tuple[int, int], sets: dict | None = None) -> list[str]:
        """The pieces after ``entry`` up to and with ``last``, walked backwards from there."""
        sets, out, span = sets or self.reach(text, {entry: 1}, last[0] + 1), [], last
        while span != entry:
            piece, at = text[span[0] : span[1]], span[0]
            out.append(piece)
            if at == entry[1] and (entry[0] == at or self.compatible(text[entry[0] : at], piece)):
                break
            span = next((s, at) for s in range(at - 1, at - self.longest - 1, -1) if (s, at) in sets and (s, at) != entry and self.compatible(text[s:at], piece))
        return out[::-1]

    def piece_ids(self, pieces: list[str]) -> bytes:
        ids = []
        for p in pieces:
            i = self.ids.get(p)
            ids += [i] if i is not None else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()

    def whole(self, text: str) -> list[str]:
        """The pieces of a closed run of text. Of a short one they are merged, as that costs least; of a longer one they are its one compatible path, tried longest piece first.

        Each place is reached by one compatible path at most, so a place given up is dead for good.
        """
        if len(text) <= SHORT:
            return self.merged(text)
        out, at, n, dead = [], 0, len(text), set()
        waiting = [self.ends(text, 0)]
        while at < n:
            if waiting[-1]:
                end = waiting[-1].pop()
                if end not in dead and (not out or self.compatible(out[-1], text[at:end])):
                    out.append(text[at:end])
                    at = end
                    waiting.append(self.ends(text, at) if at < n else [])
            else:
                waiting.pop()
                dead.add(at)
                at -= len(out.pop())
        return out

    def word_ids(self, word: str) -> bytes:
        """The ids of a run between word marks, cut where no piece of the vocabulary crosses."""
        found = self.known.get(word)
        if found is None:
            found = self.known_before.get(word)
            if found is None:
                cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.bigrams), len(word)]
                if len(cuts) > 2:
                    found = b"".join([self.word_ids(word[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
                else:
                    found = self.piece_ids(self.whole(word))
            if len(self.known) >= self.remember:
                self.known, self.known_before = {}, self.known
            if len(word) <= 64:
                self.known[word] = found
        return found

    def encode(self, normalized: str) -> bytes:
        known = self.known.get
        return b"".join([known(word) or self.word_ids(word) for word in self.words.findall(normalized)])

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        table = self._texts
        joined = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        text = joined.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    @functools.cached_property
    def _texts(self) -> list[bytes]:
        out = [b""] * self.library.vocab_size()
        for p, i in self.ids.items():
            out[i] = p.encode()
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        return out


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class Chunk:
    """Characters ``start`` to ``start + body`` of a document, and of its neighbours as many as a piece is long."""

    def __init__(self, model: PieceModel, text: str, halo: int, body: int, ends: bool):
        self.model, self.text, self.low, self.high = model, text, halo, halo + body
        self.entries = model.states(text, self.low) if halo else [(0, 0)]
        self.exits = [(s, e) for s, e in model.states(text, self.high) if not ends or e == len(text)]

    def cuts(self, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place within the chunk, from ``low`` to ``high``, that no piece crosses."""
        text, bigrams = self.text, self.model.bigrams
        places = range(max(self.low + 1, low), min(self.high - 1, high) + 1)
        first = next((k for k in places if text[k - 1 : k + 1] not in bigrams), None)
        return None if first is None else (first, next(k for k in reversed(places) if text[k - 1 : k + 1] not in bigrams))

    def matrix(self) -> list[int]:
        """For each entry the set of exits that it reaches. Where no piece crosses some place in the chunk, all entries reach the same."""
        model, text, bits = self.model, self.text, {e: 1 << k for k, e in enumerate(self.entries)}
        pos = {span: k for k, span in enumerate(self.exits)}
        if found := self.cuts(max(e for _, e in self.entries), self.high):
            first, last = found
            sets = model.reach(text, {(last, last): 1}, self.high)
            row = sum(1 << k for span, k in pos.items() if span in sets)
            head = model.reach(text, bits, first)
            alive = 0
            for (_, e), reached in head.items():
                if e == first:
                    alive |= reached
            return [row if alive >> k & 1 else 0 for k in range(len(self.entries))]
        sets = model.reach(text, bits, self.high)
        return [sum(1 << pos[span] for span in pos if sets.get(span, 0) >> k & 1) for k in range(len(self.entries))]

    def ids(self, entry: int, exit_: int) -> bytes:
        """The ids of the pieces after the entry's, up to and with the exit's."""
        model, text, first, last = self.model, self.text, self.entries[entry], self.exits[exit_]
        if first == last:
            return b""
        found = self.cuts(first[1], last[0])
        if not found:
            return model.piece_ids(model.path(text, first, last))
        a, b = found
        head = [] if first[1] == a else model.path(text, first, self._into(first, a))
        tail = model.path(text, (b, b), last)
        return model.piece_ids(head) + model.encode(text[a:b]) + model.piece_ids(tail)

    def _into(self, first, cut):
        """The piece that ends at ``cut`` on the way from ``first``: of those reachable, the one that stands alone."""
        sets = self.model.reach(self.text, {first: 1}, cut)
        return next((s, cut) for s in range(cut - 1, -1, -1) if (s, cut) in sets)


def _whole_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        model = piece_model(vocabulary)
        for batch in slices(batches):
            ids = [model.encode(model.normalize(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _chunks(docs: DataFrame, vocabulary: str, size: int) -> DataFrame:
    """The normalised texts in chunks of ``size`` characters; ``text`` has in front and behind as many characters more as a piece may have."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        model, row = piece_model(vocabulary), TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = model.normalize(text)
                starts = range(0, len(text), size)
                cut = [text[max(0, s - model.longest) : s + size + model.longest] for s in starts]
                n = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(text)] * n, pa.int64()), pa.array(cut, pa.string())], names=names)
                row += 1

    return docs.mapInArrow(run, CHUNKS)


def _chunk(model: PieceModel, size: int, start: int, n_chars: int, text: str) -> Chunk:
    return Chunk(model, text, min(start, model.longest), min(size, n_chars - start), start + size >= n_chars)


def product(first: list[int], then: list[int]) -> list[int]:
    """The transfer matrix of two neighbours: which states at the end of the second each state at the start of the first reaches."""
    out = []
    for row in first:
        reached = 0
        while row:
            k = row.bit_length() - 1
            reached |= then[k]
            row ^= 1 << k
        out.append(reached)
    return out


def scan_states(matrices: list[list[int]], entry: int = 0, exit_: int | None = None) -> list[tuple[int, int]]:
    """(entry, exit) of each of neighbouring matrices on a path from ``entry`` of the first to ``exit_`` of the last, the lowest that is reached if none is given."""
    before = [1 << entry]
    for m in matrices:
        before += product(before[-1:], m)
    at, out = before[-1] & -before[-1] if exit_ is None else 1 << exit_, []
    for k in range(len(matrices) - 1, -1, -1):
        last = at.bit_length() - 1
        start = next(i for i, row in enumerate(matrices[k]) if before[k] >> i & 1 and row >> last & 1)
        out.append((start, last))
        at = 1 << start
    return out[::-1]


def _settled(matrices: DataFrame, last: int, fan: int) -> DataFrame:
    """(row, place, entry, exit) of the matrices (row, place, matrix; places 0 to ``last`` at most) on the one path of each row. At most ``fan`` matrices are in a row of any table on the way."""

    def numbers(matrices):
        return [[int(x) for x in m["matrix"]] for m in matrices]

    def multiply(batches):
        import pyarrow as pa

        for batch in slices(batches, 16):
            rows, stretches, parts = (c.to_pylist() for c in batch.columns)
            totals = [[str(x) for x in functools.reduce(product, numbers(p))] for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(stretches, pa.int32()), pa.array(totals, pa.list_(pa.string()))], names=["row", "place", "matrix"])

    def scan(batches):
        import pyarrow as pa

        for batch in slices(batches, 16):
            found = []
            for row, parts, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += [(row, p["place"], *states) for p, states in zip(parts, scan_states(numbers(parts), first, end), strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["row", "place", "entry", "exit"])

    states, none = "row long, place int, entry int, exit int", F.lit(None).cast("int")
    parts = F.array_sort(F.collect_list(F.struct("place", "matrix"))).alias("parts")
    if last < fan:
        return matrices.groupBy("row").agg(parts).select("row", "parts", F.lit(0).alias("first"), none.alias("end")).mapInArrow(scan, states)
    stretched = saved(matrices.withColumn("stretch", F.floor(F.col("place") / fan).cast("int")).groupBy("row", "stretch").agg(parts), "matrices")
    products = stretched.mapInArrow(multiply, "row long, place int, matrix array<string>")
    ends = _settled(products, last // fan, fan).select("row", F.col("place").alias("stretch"), F.col("entry").alias("first"), F.col("exit").alias("end"))
    return stretched.join(ends, ["row", "stretch"]).select("row", "parts", "first", "end").mapInArrow(scan, states)


def recoded(ids: bytes, kind: str, other: str) -> bytes:
    """Numbers of one kind as those of another."""
    return ids if kind == other else np.frombuffer(ids, kind).astype(other).tobytes()


def _traced(chunks: DataFrame, vocabulary: str, size: int, fan: int, packed: str) -> DataFrame:
    """(row, doc_id, chunk, ids) of chunked documents: matrices by chunk, their scan, and each chunk's path, its ids as numbers of the kind ``packed``."""

    def transfer(batches):
        import pyarrow as pa

        model = piece_model(vocabulary)
        for batch in slices(batches):
            row, _, chunk, *rest = (c.to_pylist() for c in batch.columns)
            rows = [[str(x) for x in _chunk(model, size, *args).matrix()] for args in zip(*rest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(chunk, pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["row", "place", "matrix"])

    def trace(batches):
        import pyarrow as pa

        model = piece_model(vocabulary)
        for batch in slices(batches):
            row, doc_id, chunk, start, n_chars, text, entry, exit_ = (c.to_pylist() for c in batch.columns)
            ids = [recoded(_chunk(model, size, s, n, t).ids(a, b), "<u4", packed) for s, n, t, a, b in zip(start, n_chars, text, entry, exit_, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(chunk, pa.int32()), pa.array(ids, pa.binary())], names=["row", "doc_id", "chunk", "ids"])

    last = chunks.agg(F.max("chunk")).first()[0] or 0
    states = _settled(chunks.mapInArrow(transfer, "row long, place int, matrix array<string>"), last, fan).withColumnRenamed("place", "chunk")
    return chunks.join(states, ["row", "chunk"]).select("row", "doc_id", "chunk", "start", "n_chars", "text", "entry", "exit").mapInArrow(trace, "row long, doc_id long, chunk int, ids binary")


def _scanned(chunks: DataFrame, vocabulary: str, size: int, fan: int) -> DataFrame:
    """(doc_id, ids) of chunked documents, whose chunks' ids take 16 bits on their way where the vocabulary fits."""
    packed = "<u2" if piece_model(vocabulary).library.vocab_size() <= 1 << 16 else "<u4"

    def widen(batches):
        import pyarrow as pa

        for batch in slices(batches):
            ids = [recoded(x, packed, "<u4") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    traced = _traced(chunks, vocabulary, size, fan, packed)
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.expr("listagg(ids) WITHIN GROUP (ORDER BY chunk)").alias("ids")).select("doc_id", "ids")
    return whole.mapInArrow(widen, "doc_id long, ids binary")


def encode_pieces(docs: DataFrame, vocabulary: str, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id and ids, the model's ids of its whole text (little-endian unsigned 32-bit).

    The ids are those that the SentencePiece library gives, whose part is only to normalise. Texts
    over ``giant`` characters are scanned in chunks of ``chunk`` side by side; what meets in one task
    of those are ``fan`` matrices and, at last, the ids of one document. Null and empty texts have no ids. Every row gives one row,
    null doc_ids and repeated rows too; an empty table gives none. The path is unique, so there are no ties. Other columns, whatever
    their names, are not read. A model of another type than byte-pair is an error.
    """
    piece_model(vocabulary)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_ = F.coalesce(F.length("text") > giant, F.lit(False))
    chunks = saved(_chunks(rows.filter(long_), vocabulary, chunk), "chunks")
    return _whole_texts(rows.filter(~long_), vocabulary).union(_scanned(chunks, vocabulary, chunk, fan))


def decode_pieces(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids): doc_id and text. Word marks of the original text come back as blanks."""

    def run(batches):
        import pyarrow as pa

        model = piece_model(vocabulary)
        for batch in slices(batches):
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op4_piece_ids(spark, sf_dir):
    """Ids of all documents, and a digest of the text that decoding gives back."""
    vocabulary = vocabulary_path("piece_bpe_32k.model")
    encoded = encode_pieces(documents(spark, sf_dir), vocabulary)

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        model = piece_model(vocabulary)
        for batch in slices(batches):
            ids = batch.column(1).to_pylist()
            digests = [hashlib.sha256(model.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
