"""Whole-text encoding with the tokenizers library, at the price of one lookup a word."""

from __future__ import annotations

import functools
import os


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of a generation that a worker remembers, some 200 bytes each. It has two generations.
REMEMBER = 700_000
#: How byte-level tokenizers write bytes: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordEncoder:
    """Encodes texts with a tokenizer that never joins characters across ASCII white space.

    The tokenizer must also lower-case, and part letters from punctuation, as word_bpe_49k does.
    A word of Latin letters alone is one unit for its model, which then is asked directly.
    For such a tokenizer the ids of a text are the ids of its white-space-separated chunks, in
    order, so a chunk met before costs one dictionary lookup. The memory is bounded: a generation
    of about ``remember`` chunks, and the one before it, which is where those in use are found
    again once a generation is full. None of more than 64 bytes is remembered beyond its text.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.remember = remember
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.marks = {mark: self._ids([mark.decode()])[0] for mark in (b",", b".")}

    def encode(self, text: str | None, end: bytes = b"") -> bytes:
        """The ids as little-endian unsigned 32-bit integers, then ``end``. A null text is empty."""
        chunks = (text or "").encode("utf-8", "surrogatepass").split()
        if len(self.known) > self.remember:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        lacking = set(chunks).difference(known)
        if not lacking:
            return b"".join(map(known.__getitem__, chunks)) + end
        new = lacking.difference(before)
        for chunk in lacking.difference(new):
            known[chunk] = before[chunk]
        self._learn(new)
        ids = b"".join(map(known.__getitem__, chunks)) + end
        for chunk in new:
            if len(chunk) > 64:
                known.pop(chunk, None)
                known.pop(self._stem(chunk)[0], None)
        return ids

    def _learn(self, chunks: set[bytes]) -> None:
        known, tokenize, packed, marks, others = self.known, self.model.tokenize, self.packed, self.marks, []
        for chunk in chunks:
            stem, mark = self._stem(chunk)
            ids = known.get(stem)
            if ids is None:
                word = stem.decode("utf-8", "replace")
                if not stem.isalpha():
                    if not self._latin(word):
                        others.append(chunk)
                        continue
                    word = word.lower().encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = known[stem] = b"".join([packed[t.id] for t in tokenize(word)])
            known[chunk] = ids + marks[mark] if mark else ids
        known.update(zip(others, self._ids([c.decode("utf-8", "replace") for c in others]), strict=True))

    def _ids(self, words: list[str]) -> list[bytes]:
        return [b"".join([self.packed[i] for i in e.ids]) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def _latin(word: str) -> bool:
        return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word

    def _stem(self, chunk: bytes) -> tuple[bytes, bytes]:
        """The chunk without a final comma or full stop after a word of Latin letters, and that mark; their ids are the chunk's. ASCII is lower-cased as the tokenizer does."""
        if chunk.isascii() and b"<|" not in chunk:
            chunk = chunk.lower()
        mark = chunk[-1:]
        if mark == b"," or mark == b".":
            stem = chunk[:-1]
            if stem[-1:].isalpha() or self._latin(stem.decode("utf-8", "replace")):
                return stem, mark
        return chunk, b""


@functools.lru_cache(maxsize=2)
def encoder(path: str, remember: int = REMEMBER) -> WordEncoder:
    """One encoder for each vocabulary file and Python worker."""
    return WordEncoder(path, remember)
