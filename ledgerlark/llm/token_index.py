"""Token-ID output: raw id payloads in shards, and a minimal perfect hash index from document keys into them.

A written folder holds three Parquet tables. ``payload``: one row per shard with the raw ids of
consecutive documents (little-endian, 16 bits where the vocabulary allows it, else 32), their keys
and lengths, and the shard's place in the order of all ids. ``index``: one row per bucket of keys
with a hash function that gives each of its keys another slot of 0..n-1, and for each slot a
32-bit fingerprint of its key, the shard, the offset there and the length. A lookup hashes
the key to a bucket and a slot and compares one fingerprint, whatever the number of documents.
``parts``: a row for each task that wrote payload, with what lies before it.

The key of a document is its doc_id and its occurrence: 0 for the first document with that doc_id,
1 for the second, and so on. So every row can be read, and a doc_id that most rows have is spread
over shards, tasks and buckets like any others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, mix64, owned, saved, slices, small_batches
from ledgerlark.llm.encoder import encoder, vocabulary_path

SHARD_IDS = 1 << 20
BUCKET_KEYS = 1 << 14
#: Keys whose buckets and shards are looked up by number; of more, the tables are read whole.
FEW_KEYS = 4_096
NULL_KEY = -(1 << 63)
PAYLOAD = "part int, shard long, shard_start long, n_ids long, first_key long, first_seen long, last_key long, last_seen long, width int, doc_ids binary, lengths binary, ids binary"
PARTS = "part int, first_key long, base long, carried long"
INDEX = "bucket int, n_keys int, seed int, displacements binary, fingerprints binary, shards binary, offsets binary, lengths binary"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_KEY_SALT, _PRINT_SALT = np.uint64(0x51ED270B270B4F13), np.uint64(0xD1B54A32D192ED03)


def key_hash(keys: np.ndarray, seen: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A 64-bit hash of keys and occurrences."""
    return mix64(mix64(keys.astype(np.int64).view(np.uint64) ^ salt) + seen.astype(np.uint64) * _GOLDEN)


def key_fingerprint(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (key_hash(keys, seen, _PRINT_SALT) >> np.uint64(32)).astype(np.uint32)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key", "occurrence"), F.lit(buckets)).cast("int")


def seeded(keys: np.ndarray, seen: np.ndarray, seed: int) -> np.ndarray:
    """What a bucket's perfect hash is built from; another seed where two of its keys should meet."""
    return key_hash(keys, seen, _KEY_SALT + np.uint64(seed))


def occurrences(keys: np.ndarray, first_seen: int) -> np.ndarray:
    """The place of each of sorted ``keys`` among equal ones, those of the first key counted from ``first_seen``."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    seen = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
    return seen + np.where(keys == keys[0], first_seen, 0)


@dataclass
class PerfectHash:
    """Hash and displace: each group of keys has a number with which its members' hashes meet free slots; a group of one has its slot itself, negated."""

    displacements: np.ndarray
    n: int

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        """For distinct 64-bit hashes."""
        n = len(hashes)
        groups = max(1, n // 3)
        group = hashes % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group.astype(np.int64), minlength=groups)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        displacements, free = np.zeros(groups, np.int32), np.ones(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        for g in by_size[: int((sizes > 1).sum())]:
            members = hashes[order[starts[g] : starts[g] + sizes[g]]]
            tries = np.arange(1, 65, dtype=np.uint64)
            while True:
                slots = mix64(members + tries[:, None] * _GOLDEN) % np.uint64(n)
                good = free[slots.astype(np.int64)].all(axis=1)
                for k in np.flatnonzero(good):
                    if len(set(slots[k].tolist())) == len(members):
                        break
                else:
                    tries += np.uint64(64)
                    continue
                displacements[g] = int(tries[k])
                free[slots[k].astype(np.int64)] = False
                break
        singles = by_size[int((sizes > 1).sum()) : int((sizes > 0).sum())]
        displacements[singles] = -1 - np.flatnonzero(free)[: len(singles)]
        return cls(displacements, n)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; of a hash that wasn't among those built from, any slot."""
        d = self.displacements[(hashes % np.uint64(len(self.displacements))).astype(np.int64)]
        placed = (mix64(hashes + d.astype(np.int64).view(np.uint64) * _GOLDEN) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -1 - d.astype(np.int64), placed)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode the documents in ascending doc_id order, each followed by ``end_id``, and write payload and index under ``path``.

    ``path`` may be in any store that Spark writes. A shard holds whole documents, up to
    ``shard_ids`` ids or one longer document, whatever its length. Null texts are empty. Null
    doc_ids come first, under NULL_KEY (which no doc_id may be). Of equal doc_ids, null ones too,
    the order is by their place in the table, which is the same however often a task is run. Other
    columns are not read. Of an empty table all tables are empty.

    Texts are shuffled once, by ranges of doc_id and place, so that rows of one doc_id are spread
    as well; the index is built from keys and lengths alone, by bucket.
    """

    def shards(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        dtype = "<u2" if encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        end = end_id.to_bytes(4, "little")
        names = [c.split()[0] for c in PAYLOAD.split(", ")]
        types = [pa.int32(), *[pa.int64()] * 7, pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        start, number, keys, lengths, parts, held, last, seen = 0, 0, [], [], [], 0, None, 0

        def flush():
            nonlocal start, number, held, last, seen
            known = np.array([NULL_KEY if k is None else k for k in keys], "<i8")
            first_seen = seen + 1 if last == known[0] else 0
            last, seen = int(known[-1]), int(occurrences(known, first_seen)[-1])
            row = (part, (part << 32) + number, start, held, int(known[0]), first_seen, last, seen, int(dtype[-1]), known.tobytes(), np.array(lengths, "<i8").tobytes(), np.frombuffer(b"".join(parts), "<u4").astype(dtype).tobytes())
            start, number, held = start + held, number + 1, 0
            keys.clear(), lengths.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text, end)
                if keys and held + len(ids) // 4 > shard_ids:
                    yield flush()
                keys.append(doc_id), lengths.append(len(ids) // 4), parts.append(ids)
                held += len(ids) // 4
        if keys:
            yield flush()

    order = [F.asc_nulls_first("doc_id"), F.asc("place")]
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(shards, PAYLOAD).write.option("compression", "zstd").parquet(f"{path}/payload")
    payload = docs.sparkSession.read.schema(PAYLOAD).parquet(f"{path}/payload")
    _parts(payload.drop("ids", "doc_ids", "lengths")).write.parquet(f"{path}/parts")
    keys = stored_keys(docs.sparkSession, path)
    buckets = max(1, int(payload.agg(F.sum(F.octet_length("lengths") / 8)).first()[0] or 0) // BUCKET_KEYS)

    def build(rows):
        import pandas as pd

        keys, seen = rows["key"].to_numpy(), rows["occurrence"].to_numpy()
        seed = next(k for k in range(1 << 16) if len(np.unique(seeded(keys, seen, k))) == len(keys))
        hashed = seeded(keys, seen, seed)
        perfect = PerfectHash.of(hashed)
        order = np.argsort(perfect.slots(hashed))
        column = lambda x, t: x[order].astype(t).tobytes()
        values = (int(rows["bucket"].iloc[0]), len(keys), seed, perfect.displacements.astype("<i4").tobytes(), column(key_fingerprint(keys, seen), "<u4"), *(column(rows[c].to_numpy(), "<i8") for c in ("shard", "offset", "length")))
        return pd.DataFrame([values], columns=[c.split()[0] for c in INDEX.split(", ")])

    placed = keys.withColumn("bucket", _bucket(buckets)).repartitionByRange("bucket")  # so a file has neighbouring buckets
    placed.groupBy("bucket").applyInPandas(build, INDEX).write.option("compression", "zstd").parquet(f"{path}/index")


def _parts(payload: DataFrame) -> DataFrame:
    """(part, first_key, base, carried): the number of ids before each part, and of rows before it that have its first key. One row per task that wrote."""
    last = F.max_by(F.struct("last_key", "last_seen"), "shard")
    parts = payload.groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.min_by("first_key", "shard").alias("first_key"), last.alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(parts, "parts")
    # parts follow each other by key, so those before a part that end with its first key are the ones just before it
    same = Window.partitionBy("end_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", "first_key", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    ends = parts.select("part", F.col("last.last_key").alias("end_key"), (F.col("last.last_seen") + 1).alias("n"), F.lit(True).alias("counts"))
    asks = parts.select("part", F.col("first_key").alias("end_key"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("counts"))
    carried = ends.union(asks).groupBy("part", "end_key").agg(F.sum("n").alias("n"), F.min("counts").alias("only_ends"))
    carried = carried.withColumn("carried", F.coalesce(F.sum("n").over(same), F.lit(0))).filter("NOT only_ends").select("part", "carried")
    return bases.join(carried, "part").select("part", "first_key", "base", "carried")


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, occurrence, key, shard, offset, length) of every document written under ``path``; ``key`` is the doc_id, or NULL_KEY for null."""
    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload").drop("ids")
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts")
    known = payload.join(F.broadcast(parts.select("part", F.col("first_key").alias("part_key"), "carried")), "part")  # a row a task

    def entries(batches):
        import pyarrow as pa

        for batch in slices(batches, 16):
            for shard, first_seen, part_key, carried, keys, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, lengths = np.frombuffer(keys, "<i8"), np.frombuffer(lengths, "<i8")
                offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                seen = occurrences(keys, first_seen) + np.where(keys == part_key, carried, 0)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys, seen, np.full(len(keys), shard), offsets, lengths)], names=["key", "occurrence", "shard", "offset", "length"])

    found = known.select("shard", "first_seen", "part_key", "carried", "doc_ids", "lengths").mapInArrow(entries, "key long, occurrence long, shard long, offset long, length long")
    return found.select(F.nullif("key", F.lit(NULL_KEY)).alias("doc_id"), "occurrence", "key", "shard", "offset", "length")


def _located(spark: SparkSession, path: str, keys: DataFrame, few: bool) -> DataFrame:
    """(key, occurrence, shard, offset, length) of those keys that the index under ``path`` has; of ``few`` keys, only their buckets are read."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    buckets = (index.agg(F.max("bucket")).first()[0] or 0) + 1
    names = ["key", "occurrence", "shard", "offset", "length"]

    def find(wanted, blobs):
        import pandas as pd

        ids, seen = wanted["key"].to_numpy(), wanted["occurrence"].to_numpy()
        if not len(blobs) or not len(ids):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in names})
        row = blobs.iloc[0]
        slots = PerfectHash(np.frombuffer(row.displacements, "<i4"), int(row.n_keys)).slots(seeded(ids, seen, int(row.seed)))
        hit = np.frombuffer(row.fingerprints, "<u4")[slots] == key_fingerprint(ids, seen)
        columns = {c: np.frombuffer(row[f"{c}s"], "<i8")[slots[hit]] for c in names[2:]}
        return pd.DataFrame({"key": ids[hit], "occurrence": seen[hit]} | columns)

    seen = F.col("occurrence").cast("long") if "occurrence" in keys.columns else F.lit(0).cast("long")
    wanted = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), seen.alias("occurrence")).withColumn("bucket", _bucket(buckets))
    if few:
        index = index.filter(F.col("bucket").isin([r.bucket for r in wanted.select("bucket").distinct().collect()]))
    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, ", ".join(f"{c} long" for c in names))


def read_tokens(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, occurrence, start, n_tokens, ids) for each row of ``keys`` that the index under ``path`` has.

    ``keys``: doc_id and, if there is such a column, occurrence; without it the first document of
    each doc_id is meant. ``start`` is the number of ids of all documents before it, ``ids``
    little-endian unsigned 32-bit integers. Unknown keys give no row, but for one in 2**32; keys
    asked for several times give a row each.

    For up to FEW_KEYS keys, the numbers of their buckets, and then of their shards, go to the scans
    as filters: both tables are written in the order of these numbers, so only files and row groups
    that hold some are read. More keys read both tables whole.
    """
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    payload, found = spark.read.schema(PAYLOAD).parquet(f"{path}/payload"), _located(spark, path, keys, few)
    if few:
        found = saved(found, "located")
        payload = payload.filter(F.col("shard").isin([r.shard for r in found.select("shard").distinct().collect()]))
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts").select("part", "base")
    shards = payload.join(F.broadcast(parts), "part").select("shard", (F.col("base") + F.col("shard_start")).alias("shard_start"), "width", "ids")

    def cut(wanted, shard):
        import pandas as pd

        names = ["doc_id", "occurrence", "start", "n_tokens", "ids"]
        if not len(wanted) or not len(shard):
            return pd.DataFrame({c: [] for c in names})
        row = shard.iloc[0]
        ids = np.frombuffer(row.ids, f"<u{row.width}").astype("<u4").tobytes()
        cuts = [ids[4 * o : 4 * (o + n)] for o, n in zip(wanted["offset"], wanted["length"], strict=True)]
        return pd.DataFrame({"doc_id": wanted["key"], "occurrence": wanted["occurrence"], "start": row.shard_start + wanted["offset"], "n_tokens": wanted["length"], "ids": cuts})

    found = found.groupBy("shard").cogroup(shards.groupBy("shard")).applyInPandas(cut, "doc_id long, occurrence long, start long, n_tokens long, ids binary")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_KEY)))


def op3_token_index(spark, sf_dir):
    """All documents written as token ids and read back by key, each occurrence of a doc_id its own."""
    path = owned(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, vocabulary_path())
    found = read_tokens(spark, path, stored_keys(spark, path).select("doc_id", "occurrence"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "occurrence")
