"""What the operators of this subpackage share: words and hashes, beside the library's scratch tables."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.scratch import mark, numbered, owned, release, saved

__all__ = ["documents", "hash_words", "let", "lower_words_of", "mark", "mix64", "numbered", "owned", "release", "saved", "slices", "small_batches", "trimmed", "window_hashes", "words_of"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value, body):
    """``body(value)`` as a column, with ``value`` evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(docs: DataFrame, size: str = "8m") -> DataFrame:
    """``docs``; their session then hands texts to Python in Arrow batches of 8 MB at most, unless it has a bound of its own. The JVM and Python hold a batch each, and Spark's 64 MB are much for an executor of few GB."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, size)
    return docs


def slices(batches, rows: int = 256):
    """The Arrow batches in slices of few rows, so that a task never holds a whole batch as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def trimmed(run):
    """``run``, a function over Arrow batches, that gives free memory back to the machine when a task ends: a worker that waits, or goes on with another stage, then holds what that one needs."""

    @functools.wraps(run)
    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def words_of(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a text, as UTF-8 bytes; bytes.split() parts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """Like words_of, with A-Z (and no other letters) lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array([*words, None], dtype=object)[:-1], categorize=False)


_MIXED = tuple(map(np.uint64, (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31)))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers whose bits all depend on all input bits."""
    a, times, b, then, c = _MIXED
    y = x >> a
    y ^= x
    y *= times
    y ^= y >> b
    y *= then
    y ^= y >> c
    return y


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive word hashes (none if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out
