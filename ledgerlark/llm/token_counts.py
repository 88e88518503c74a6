"""Token counts: how many word pieces greedy longest-match splitting makes, without making them.

The vocabulary is a trie of word-initial pieces beside a trie of continuing pieces. Each node has
a failure link (where matching goes on when the next character has no edge) and the number of
pieces that are complete by then. A word is read once, character by character; the counts along
the failure links taken add up to its number of pieces.
"""

from __future__ import annotations

import functools
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, slices, small_batches, words_of

SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


class PieceCounter:
    """Longest-match automaton over ``initial`` and ``continuing`` pieces."""

    def __init__(self, initial, continuing):
        self.edges: list[dict[str, int]] = [{}, {}]
        self.inside = 1
        ends = set()
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.edges[node].setdefault(c, len(self.edges))
                    if node == len(self.edges):
                        self.edges.append({})
                if piece:
                    ends.add(node)
        self.fail: list[int] = [-1] * len(self.edges)
        self.popped: list[int] = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.edges[node].items():
                queue.append(child)
                if child in ends:
                    self.fail[child], self.popped[child] = self.inside, 1
                    continue
                z, n = self.fail[node], self.popped[node]
                while z >= 0 and c not in self.edges[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[child], self.popped[child] = self.edges[z][c], n

    def count(self, word: str) -> int:
        """The number of pieces of ``word``; 0 if no sequence of greedy pieces covers it."""
        edges, fail, popped, node, n = self.edges, self.fail, self.popped, 0, 0
        for c in word:
            while c not in edges[node]:
                if fail[node] < 0:
                    return 0
                n += popped[node]
                node = fail[node]
            node = edges[node][c]
        while node > self.inside:
            if fail[node] < 0:
                return 0
            n += popped[node]
            node = fail[node]
        return n


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces of a SentencePiece model: those with a word mark before them, and the others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in plain if p.startswith("▁") and len(p) > 1], [p for p in plain if not p.startswith("▁")]


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(*sentencepiece_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary: str, remember: int = 500_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens (word pieces; an uncoverable word counts as one) and n_unknown.

    Words are the runs of other than ASCII white space of the whole text. ``vocabulary`` is a
    SentencePiece model file. Null and empty texts count 0 words; very long ones are counted
    whole; rows with a null doc_id and repeated rows each give a row; an empty table gives none.
    Greedy pieces are unique, so there are no ties. Other columns, whatever their names, are not
    read. No shuffle. A worker remembers the counts of up to ``remember`` words.
    """

    def count(batches):
        import pyarrow as pa

        counter, known = _counter(vocabulary), {}
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                total = unknown = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = counter.count(w.decode("utf-8", "replace"))
                        if len(known) >= remember:
                            known.clear()
                        if len(w) <= 64:
                            known[w] = n
                    total += n or 1
                    unknown += not n
                rows.append((len(words), total, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], [])))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(count, SCHEMA)


def op10_token_counts(spark, sf_dir):
    """Word-piece counts of all documents."""
    from ledgerlark.llm.encoder import vocabulary_path

    return token_counts(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))
