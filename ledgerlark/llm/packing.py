"""Packing: fill sequences of fixed length with whole documents by minimum bin slack.

Each task keeps a pool of pieces (documents, cut only where longer than a sequence). A sequence
starts with the longest piece; a subset-sum over the pool's multiset of lengths, held as the bits
of one integer, finds the remaining lengths that come closest to its capacity, and walking the
steps back gives how many pieces of each length to take. Nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, slices, small_batches, trimmed
from ledgerlark.llm.encoder import REMEMBER, encoder, vocabulary_path

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def least_slack(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum is as near to ``room`` as can be, not above.

    ``lengths`` lists the keys of ``counts``, longest first; the search ends at the first exact fit.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        left, copies = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= reach << length * copies & full
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    rest, taken = reach.bit_length() - 1, defaultdict(int)
    for before, length, copies in reversed(steps):
        if not before >> rest & 1:
            rest -= length * copies
            taken[length] += copies
    return taken


class Packer:
    """A pool of pieces that gives one filled sequence after another."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.size = 0

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        self.pool[len(ids) // 4].append((doc_id, start, ids, doc_tokens))
        self.size += 1

    def _take(self, length: int) -> tuple:
        self.size -= 1
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        return piece

    def sequence(self, cut: bool = False) -> list[tuple]:
        """The next sequence's pieces; with ``cut``, what no subset fills is filled with the head of another piece."""
        first = max(self.pool)
        chosen, room = [self._take(first)], self.capacity - first
        if room and self.pool:
            counts = {n: len(p) for n, p in self.pool.items()}
            for length, copies in least_slack(counts, sorted(counts, reverse=True), room).items():
                chosen += [self._take(length) for _ in range(copies)]
                room -= length * copies
        if room and cut and self.pool:
            doc_id, start, ids, doc_tokens = self._take(max(self.pool))
            chosen.append((doc_id, start, ids[: 4 * room], doc_tokens))
            self.add(doc_id, start + room, ids[4 * room :], doc_tokens)
        return chosen


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, pool: int = 4096, remember: int = REMEMBER, forget: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document is the ids of its whole text and then ``end_id``; a null or empty text is the end
    id alone. Documents longer than ``capacity`` are cut into full sequences and a rest; each task
    packs rests once ``pool`` of them wait, and cuts only when its input has ended and no subset
    fills a sequence, so that only a task's last sequence needs padding. Each row of the input is
    packed once, repeated rows and null doc_ids too; an empty table gives no rows. Very long texts
    are encoded whole. Of pieces of one length the last that came goes first; of subsets that come
    as near, that of longer pieces. A worker remembers words in two
    generations of ``remember``, and forgets them and the vocabulary at the end of a task if it shall ``forget``. Other columns, whatever their names, are not read. A sequence
    lies in one task: its number is the task's partition times 2**32 plus its rank there.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
        encode, packer, rows, held = encoder(vocabulary, remember).encode, Packer(capacity), [], 0
        number = TaskContext.get().partitionId() << 32

        def put(pieces):
            nonlocal number, held
            offset = 0
            for doc_id, start, ids, doc_tokens in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, doc_tokens, number, offset, ids))
                offset += n
            held += offset
            number += 1

        def flush():
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            held = 0
            return batch

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text, end)
                total, start = len(ids) // 4, 0
                while total - start >= capacity:
                    put([(doc_id, start, ids[4 * start : 4 * (start + capacity)], total)])
                    start += capacity
                if start < total:
                    packer.add(doc_id, start, ids[4 * start :], total)
                while packer.size >= pool:
                    put(packer.sequence())
                if held >= 1 << 20:
                    yield flush()
        while packer.size:
            put(packer.sequence(cut=True))
            if held >= 1 << 20:
                yield flush()
        if rows:
            yield flush()
        if forget:
            del encode
            encoder.cache_clear()

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), SCHEMA)


def op8_pack_sequences(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    pieces = pack(documents(spark, sf_dir), vocabulary_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
