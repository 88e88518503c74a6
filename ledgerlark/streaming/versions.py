"""A table by key whose versions share files: merges that rewrite only what holds their keys, and versions compared by a hash tree.

Keys are dealt to buckets by hash; a bucket has a few files. A version is a manifest: for each file
its rows, least and greatest key, a Bloom filter of its keys and a digest of its rows. A merge asks
the manifest which files may hold one of its keys, and rewrites those; all others go on as they
are. Digests add up, file to bucket, and are hashed upwards from buckets to a root, so two versions are
compared from the root down, and only buckets that differ are read.

A version is published by creating a file that must not be there yet: of two writers one wins, and
the other merges anew into what the first has left. A writer that dies leaves nothing that counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.operators.joins import enrich
from ledgerlark.operators.scratch import mark, release, saved
from ledgerlark.sources.readers import children

#: A file of a version; ``total`` and ``mix`` are the sum and the exclusive or of its rows' hashes.
FILE = "file string, bucket int, n long, low string, high string, bloom binary, total decimal(38,0), mix long"
FANOUT = 16
#: Bits of a Bloom filter for a key, and how many of them are set: one in 120 other keys is taken for one of the file's.
BITS, PROBES = 10, 7
#: The most rows of a file, and about the most keys that are asked of a bucket's files at once, so no task holds more however large the table is.
FILE_ROWS = 50_000


class Conflict(Exception):
    """Another writer has published the version."""


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of keys with these 64-bit hashes, a row for each key."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    bits = max(64, len(hashes) * BITS)
    held = np.zeros(bits, np.uint8)
    held[positions(hashes, bits).ravel()] = 1
    return bits.to_bytes(8, "little") + np.packbits(held).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which keys the filter's file may have."""
    bits = int.from_bytes(filter_[:8], "little")
    held = np.unpackbits(np.frombuffer(filter_, np.uint8, offset=8))
    return held[positions(hashes, bits)].all(axis=1)


class VersionedTable:
    """The versions of a table under ``path``, each row with a string ``key`` of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str = "id", buckets: int = 256, most_files: int = 8):
        self.spark, self.path, self.key, self.buckets, self.most_files = spark, path.rstrip("/"), key, buckets, most_files
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def latest(self) -> int:
        """The last version; 0 if there is none."""
        return max((int(n) for n in children(self.spark, f"{self.path}/versions") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """FILE of a version's files."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], FILE)
        name = self.spark.read.text(f"{self.path}/versions/{version}").first()[0]
        return self.spark.read.schema(FILE).parquet(f"{self.path}/manifests/{name}")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of all or of some buckets; only their files are opened."""
        files = self.manifest(version)
        files = files if buckets is None else files.filter(F.col("bucket").isin(buckets))
        return self._rows([r.file for r in files.select("file").collect()])

    def enriched(self, members: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of a version with what the roster has of their members now, so a new roster needs no rewriting."""
        return enrich(self.read(version), members)

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in files)) if files else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("bucket")

    def _written(self, rows: DataFrame, name: str) -> None:
        """Write rows by bucket and key, so the files of a bucket have FILE_ROWS rows at most and ranges of keys of their own."""
        tasks = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.withColumn("bucket", self._bucket()).repartition(tasks, "bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/data/{name}")

    def merge(self, incoming: DataFrame, sequence: str | None = None, tries: int = 5) -> dict[str, int]:
        """Publish a version with the ``incoming`` rows in place of those with their keys, and tell what it took.

        Of several incoming rows of a key the one with the largest ``sequence`` stays; rows without a
        key are left out. Without rows no version is published. Where another writer publishes
        first, the merge starts again from that version. Told are the version, the files there
        were, the ones rewritten, and the rows read of them and written.
        """
        began = mark()
        rank = F.struct(F.col(sequence) if sequence else F.lit(0), F.xxhash64(*self.schema.names))
        last = incoming.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), rank).alias("_r")).select("_r.*")
        last = saved(last, "incoming")
        try:
            for _ in range(tries):
                try:
                    return self._merged(last)
                except Conflict:
                    continue
            raise Conflict(f"{tries} other writers were first")
        finally:
            release(self.spark, began)

    def _merged(self, last: DataFrame) -> dict[str, int]:
        version = self.latest()
        files, n = self.manifest(version), last.count()
        told = {"version": version, "files": files.count(), "rewritten": 0, "rows_read": 0, "rows_written": 0}
        if not n:
            return told
        touched = [(r.file, r.n) for r in self._touched(last, files, n).collect()]  # names of files, as a listing has them
        rows = last
        if touched:  # else no key of a new table needs to be held against its rows
            rows = self._rows([f for f, _ in touched]).join(last.select(self.key), self.key, "left_anti").select(self.schema.names).unionByName(last)
        name = uuid.uuid4().hex
        self._written(rows, name)
        kept = files.filter(~F.col("file").isin([f for f, _ in touched])) if touched else files
        self._published(version + 1, kept, self._described(name))
        told |= {"version": version + 1, "rewritten": len(touched), "rows_read": sum(k for _, k in touched)}
        return told | {"rows_written": self._described_rows(version + 1, name)}

    def _described_rows(self, version: int, name: str) -> int:
        return self.manifest(version).filter(F.col("file").startswith(name)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _touched(self, last: DataFrame, files: DataFrame, keys: int) -> DataFrame:
        """(file, n) of the files that may hold one of the ``keys`` keys, and of all small files of buckets that have too many of these."""
        key, crowded, small = self.key, self.most_files, FILE_ROWS // 2
        slices = -(-keys // (self.buckets * FILE_ROWS)) or 1

        def run(wanted, held):
            import pyarrow as pa

            found = []
            if wanted.num_rows:
                hashes, keys = wanted.column("h").to_numpy(), np.array(wanted.column(key).to_pylist(), object)
                many = sum(n < small for n in held.column("n").to_pylist()) >= crowded
                for file, n, low, high, filter_ in zip(*(held.column(c).to_pylist() for c in ("file", "n", "low", "high", "bloom")), strict=True):
                    between = (keys >= low) & (keys <= high)
                    if (many and n < small) or may_hold(filter_, hashes[between]).any():
                        found.append((file, n))
            return pa.Table.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["file", "n"])

        part = F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(slices)).cast("int").alias("slice")
        wanted = last.select(key, F.xxhash64(key).alias("h"), self._bucket(), part)
        asked = files.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        by = ["bucket", "slice"]
        return wanted.groupBy(by).cogroup(asked.groupBy(by)).applyInArrow(run, "file string, n long").distinct()

    def _described(self, name: str) -> DataFrame:
        """FILE of the files just written under ``name``."""
        key = self.key

        def run(_, table):
            import pyarrow as pa

            keys, hashes, digests = table.column(key).to_pylist(), table.column("h").to_numpy(), table.column("_x").to_numpy()
            about = {"file": [table.column("file")[0].as_py()], "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "n": [len(keys)], "low": [min(keys)], "high": [max(keys)], "bloom": pa.array([bloom(hashes)], pa.binary())}
            return pa.table(about | {"total": pa.array([Decimal(sum(digests.tolist()))], pa.decimal128(38, 0)), "mix": [int(np.bitwise_xor.reduce(digests))]})

        rows = self.spark.read.schema(StructType([*self.schema.fields, *StructType.fromDDL("bucket int")])).parquet(f"{self.path}/data/{name}")
        file = F.concat(F.lit(f"{name}/"), F.regexp_extract(F.input_file_name(), r"(bucket=[^/]+/[^/]+)$", 1)).alias("file")
        marked = rows.select(file, "bucket", key, F.xxhash64(key).alias("h"), self._row_hash().alias("_x"))
        return marked.groupBy("file").applyInArrow(run, FILE)

    def _row_hash(self) -> F.Column:
        return F.xxhash64(F.to_json(F.struct(*self.schema.names), {"ignoreNullFields": "false"}))

    def _published(self, version: int, kept: DataFrame, new: DataFrame) -> None:
        """Write the manifest, described in as many tasks as there are, then create the file that makes it the version; Conflict where that is there."""
        name = uuid.uuid4().hex
        kept.unionByName(new).hint("rebalance").write.parquet(f"{self.path}/manifests/{name}")
        jvm, path = self.spark._jvm, f"{self.path}/versions/{version}"
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(target.getParent())
        try:
            out = files.create(target, False)  # not over another's
        except Exception as error:  # noqa: BLE001 - of the store's own kind
            raise Conflict(path) from error
        out.write(bytearray(f"{name}\n".encode()))
        out.close()

    def tree(self, version: int | None = None) -> DataFrame:
        """(level, node, digest) of a version: buckets at level 0, FANOUT of them under a node of the next level, up to one root."""
        empty = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
        sums = self.manifest(version).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mix").alias("mix"))
        leaves = empty.join(sums, "bucket", "left")
        digest = F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("n", "total", "mix"))), 256)
        level, found, size = leaves.select(F.lit(0).alias("level"), F.col("bucket").cast("long").alias("node"), digest.alias("digest")), [], self.buckets
        while True:
            found.append(level)
            if size <= 1:
                break
            texts = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])
            level = level.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sha2(F.array_join(texts, ""), 256).alias("digest"))
            size = -(-size // FANOUT)
        whole = found[0]
        for more in found[1:]:
            whole = whole.union(more)
        return whole

    def differing_buckets(self, before: int, after: int) -> list[int]:
        """The buckets in which two versions differ, by going down the trees from the root where digests differ."""
        trees = [saved(self.tree(v), "tree") for v in (before, after)]
        top = trees[0].agg(F.max("level")).first()[0]
        nodes = None
        for level in range(top, -1, -1):
            old, new = (t.filter(F.col("level") == level) for t in trees)
            if nodes is not None:
                below = F.floor(F.col("node") / FANOUT).isin(nodes)
                old, new = old.filter(below), new.filter(below)
            pairs = old.join(new.select("node", F.col("digest").alias("_new")), "node").filter("digest <> _new")
            nodes = [r.node for r in pairs.select("node").collect()]  # at most as many as buckets
            if not nodes:
                return []
        return sorted(nodes)

    def changes(self, before: int, after: int) -> DataFrame:
        """(key, change) of the rows by which two versions differ: added, removed or changed. Equal buckets are not read."""
        buckets = self.differing_buckets(before, after)
        old, new = (self.read(v, buckets).select(F.col(self.key).alias("key"), self._row_hash().alias(name)) for v, name in ((before, "_old"), (after, "_new")))
        kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
        return old.join(new, "key", "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("key", kind.alias("change"))

    def delete(self, rows: Callable[[DataFrame], DataFrame]) -> int:
        """Publish a version without the rows that ``rows`` picks from the table, rewriting the files that hold some; its number."""
        began, version = mark(), self.latest()
        gone = saved(rows(self.read(version)).select(self.key).distinct(), "gone")
        files = self.manifest(version)
        n = gone.count()
        touched = [r.file for r in self._touched(gone, files, n).select("file").collect()]
        if not n:
            release(self.spark, began)
            return version
        name = uuid.uuid4().hex
        stay = self._rows(touched).join(gone, self.key, "left_anti").select(self.schema.names)
        self._written(stay, name)
        new = self._described(name) if not stay.isEmpty() else self.spark.createDataFrame([], FILE)
        self._published(version + 1, files.filter(~F.col("file").isin(touched)), new)
        release(self.spark, began)
        return version + 1
