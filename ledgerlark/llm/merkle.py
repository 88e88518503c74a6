"""Merkle manifests of a dataset: digests of rows, folded by mountain-range stacks into one root, with a proof for each row.

Leaves are dealt by range, so each partition is a run of leaves with known places. A chunk of such
a run goes over a stack: a leaf is pushed, and whenever the top of the stack ends a run of
``fanout`` sister nodes, these carry into their parent, as digits do in a number of that base. What
stays on the stack are the chunk's peaks. Peaks of neighbouring chunks, cut wherever partitions
end, are merged the same way in further rounds, each over ``fanout ** height`` times as many
leaves, until each group of leaves has one node. The last run of a level may be short: it is
hashed as it is, without padding, which a stack can do because it knows how many nodes each level has.

On the way up each node keeps its path to the peak above it; on the way down the paths are put
together, round by round, so each leaf has its siblings up to the root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, mark, release, saved

#: A node: its group, how many leaves that has, its level and place there, its digest; the peak above it and the path to that; of a leaf, its key and a digest to try in its place; whether it came in or was made.
NODE = "grp binary, n long, level int, idx long, digest binary, peak_level int, peak_idx long, path binary, key long, altered binary, made boolean"
#: Leaves of a chunk, at most: the largest power of the fanout that isn't larger.
CHUNK = 4096


def hashed(digests) -> bytes:
    """H of some digests: sha256 of their lowercase hex texts, one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def step(before, after) -> bytes:
    """One level of a path: how many siblings stand before and after the node, and their digests."""
    return bytes([len(before), len(after)]) + b"".join([*before, *after])


def steps(path: bytes):
    """The levels of a path, as (siblings before, siblings after)."""
    at = 0
    while at < len(path):
        before, after = path[at], path[at + 1]
        found = [path[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(before + after)]
        yield found[:before], found[before:]
        at += 2 + 32 * (before + after)


def folded(digest: bytes, path: bytes) -> bytes:
    """The digest that a node and its siblings come to at the end of a path."""
    for before, after in steps(path):
        digest = hashed([*before, digest, *after])
    return digest


class Mountains:
    """The stack of one chunk: nodes go in by their places, peaks are left."""

    def __init__(self, n: int, fanout: int):
        self.fanout, self.sizes, self.stack, self.above, self.made = fanout, [n], [], {}, {}
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))

    def push(self, level: int, idx: int, digest: bytes) -> None:
        """Push a node; carry as long as the top of the stack ends a run that is there from its beginning."""
        self.stack.append((level, idx, digest))
        while level < len(self.sizes) - 1:
            run = idx // self.fanout
            length = min(self.fanout, self.sizes[level] - run * self.fanout)
            if idx != run * self.fanout + length - 1 or len(self.stack) < length:
                return
            sisters = self.stack[-length:]
            if sisters[0][:2] != (level, run * self.fanout):
                return
            digests = [d for _, _, d in sisters]
            del self.stack[-length:]
            for k, (_, i, _) in enumerate(sisters):
                self.above[level, i] = (level + 1, run, step(digests[:k], digests[k + 1 :]))
            level, idx = level + 1, run
            self.made[level, idx] = hashed(digests)
            self.stack.append((level, idx, self.made[level, idx]))

    def path(self, level: int, idx: int) -> tuple[int, int, bytes]:
        """The peak above a node and the path to it."""
        found = []
        while (level, idx) in self.above:
            level, idx, siblings = self.above[level, idx]
            found.append(siblings)
        return level, idx, b"".join(found)


def _merged(nodes: DataFrame, chunk: list[Column], fanout: int) -> DataFrame:
    """The nodes (grp, n, level, idx, digest, key, altered), a stack for each ``chunk`` of them: NODE of those that came in, with their paths, and of those made of them."""

    def run(_, table):
        import pyarrow as pa

        columns = (table.column(c).to_pylist() for c in ("level", "idx", "digest", "key", "altered"))
        rows = sorted(zip(*columns, strict=True), key=lambda r: r[1] * fanout ** r[0])
        group = table.column("grp")[0].as_py(), table.column("n")[0].as_py()
        mountains = Mountains(group[1], fanout)
        for level, idx, digest, _, _ in rows:
            mountains.push(level, idx, digest)
        out = [(*group, level, idx, digest, *mountains.path(level, idx), key, altered, False) for level, idx, digest, key, altered in rows]
        out += [(*group, level, idx, digest, *mountains.path(level, idx)[:2], None, None, None, True) for (level, idx), digest in mountains.made.items()]
        names, kinds = zip(*(c.split() for c in NODE.split(", ")), strict=True)
        arrow = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        return pa.Table.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    keys = [f"_chunk{k}" for k in range(len(chunk))]
    keyed = nodes.select("grp", "n", "level", "idx", "digest", "key", "altered", *(c.alias(k) for k, c in zip(keys, chunk, strict=True)))
    return keyed.groupBy("grp", *keys).applyInArrow(run, NODE)


def _indexed(leaves: DataFrame, by: list[str]) -> DataFrame:
    """``leaves`` with their place in their group (idx), its number of leaves (n) and the partition that they are dealt to (part).

    Groups are cut by range, rows that are alike in all of ``by`` too, so no group is one task. Only
    the counts of (partition, group) are joined; up to 100,000 of them are broadcast.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", *by, "_tie"]
    dealt = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = saved(dealt.drop("_tie").withColumns({"part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "leaves")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    runs = runs.select("grp", "part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    runs = saved(runs, "runs")
    few = runs.count() <= 100_000
    joined = placed.join(F.broadcast(runs) if few else runs, ["grp", "part"])
    return joined.withColumn("idx", F.col("_start") + F.col("_place") - F.col("_first")).drop("_start", "_place", "_first")


def _spread(upper: DataFrame, few: int = 20_000) -> DataFrame:
    """``upper``, broadcast if it has ``few`` rows at most: a path of 40 levels of two nodes has 1.4 KB."""
    return F.broadcast(upper) if upper.count() <= few else upper


class Tree:
    """The trees over groups of leaves (grp, digest, key, altered, and the columns ``by`` that order them)."""

    def __init__(self, leaves: DataFrame, by: list[str], fanout: int = 2):
        if not 2 <= fanout <= 127:
            raise ValueError("a node has 2 to 127 children")
        self.width = fanout
        while self.width * fanout <= CHUNK:
            self.width *= fanout
        placed = _indexed(leaves, by).withColumn("level", F.lit(0))
        largest = placed.agg(F.max("n")).first()[0] or 0
        first = F.col("idx") * F.pow(F.lit(fanout), F.col("level")).cast("long")
        self.rounds = [saved(_merged(placed, [F.col("part"), F.floor(F.col("idx") / self.width)], fanout), "nodes")]
        reach = self.width
        while len(self.rounds) < 2 or reach < largest:
            reach *= self.width
            self.rounds.append(saved(_merged(self.peaks(), [F.floor(first / F.lit(reach))], fanout), "nodes"))

    def peaks(self) -> DataFrame:
        """What the last round left on its stacks: at the end, the root of each group."""
        return self.rounds[-1].filter("level = peak_level AND idx = peak_idx")

    def records(self) -> DataFrame:
        """All nodes (grp, n, level, idx, digest): the leaves at level 0, and each node made in any round."""
        found = [r.filter("made" if k else "true") for k, r in enumerate(self.rounds)]
        whole = found[0]
        for more in found[1:]:
            whole = whole.union(more)
        return whole.select("grp", "n", "level", "idx", "digest")

    def leaves(self, top: DataFrame | None = None) -> DataFrame:
        """(grp, n, idx, digest, key, altered, subroot, root, path) of each leaf. ``top``: (subroot_grp, subroot, root, path) of each group, to go on from its root; without it, paths end there.

        What belongs to a group is joined to what came into the last round, a few nodes for each
        group, and goes down with the paths; so no leaves are shuffled by their group alone.
        """
        if top is None:
            top = self.peaks().select(F.col("grp").alias("subroot_grp"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.lit(b"").alias("path"))
        last = self.rounds[-1].filter("NOT made").join(_spread(top.withColumnRenamed("path", "_top")), F.col("grp") == F.col("subroot_grp"))
        upper = last.withColumn("path", F.concat("path", "_top"))
        for nodes in reversed(self.rounds[:-1]):
            upper = saved(upper.select(F.col("grp").alias("_grp"), F.col("level").alias("_level"), F.col("idx").alias("_idx"), F.col("path").alias("_path"), "subroot", "root"), "paths")
            self.paths = upper
            same = (F.col("grp") == F.col("_grp")) & (F.col("peak_level") == F.col("_level")) & (F.col("peak_idx") == F.col("_idx"))
            upper = nodes.filter("NOT made").join(_spread(upper), same).withColumn("path", F.concat("path", "_path"))
        return upper.select("grp", "n", "idx", "digest", "key", "altered", "subroot", "root", "path")


def row_digest(*columns: Column) -> Column:
    """H of a row's columns, as bytes: ``-`` for a null, else the UTF-8 byte count of its text form, ``:`` and that text."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def group_key(column: Column) -> Column:
    """Bytes that order like the texts of ``column`` bytewise, nulls first."""
    return F.coalesce(F.concat(F.lit(b"\x01"), column.cast("string").cast("binary")), F.lit(b"\x00"))


def manifest(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """One row per leaf (grp, key, digest, altered): also n, idx, subroot, root and path, its siblings up to the root.

    A group (``grp``, bytes) orders its leaves by ``key`` (a long, nulls first) and then by digest;
    every ``fanout`` consecutive nodes have H of their digests as parent, the last run of a level
    what there is, until one node is left, the group's ``subroot``. The subroots, in the order of
    the groups' bytes, have the ``root`` in the same way. ``altered`` goes along.

    Repeated rows are leaves of their own, side by side; equal keys are ordered by digest. A group
    of one leaf has that as subroot; an empty table gives no rows. Very long texts and clashing
    columns don't come here: a leaf is a digest. A group may have most of the rows: it is cut by
    range, chunks have at most 4096 leaves, and each further round reads what 4096 times as many came to.
    """
    spark, began = leaves.sparkSession, mark()
    tree = Tree(leaves, ["key", "digest"], fanout)
    roots = tree.peaks().select(F.lit(b"").alias("grp"), F.col("grp").alias("of"), "digest", F.lit(None).cast("long").alias("key"), F.col("grp").alias("altered"))
    top = saved(Tree(roots, ["of"], fanout).leaves().select(F.col("altered").alias("subroot_grp"), F.col("digest").alias("subroot"), "root", "path"), "subroots")
    out = tree.leaves(top)
    release(spark, began, (tree.rounds[0], tree.paths))
    return out


#: A leaf as proofs() returns it.
PROVEN = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(leaves: DataFrame) -> DataFrame:
    """PROVEN of each row of manifest(): H of its siblings, from its own level to the root's, left to right (of none: of the empty text), and the root that its altered leaf, else its own, folds to with them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], [], [], []]
            for key, digest, altered, subroot, root, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                siblings = [d for before, after in steps(path) for d in (*before, *after)]
                reached = folded(digest if altered is None else altered, path)
                for column, value in zip(out, (key, digest.hex(), subroot.hex(), root.hex(), hashed(siblings).hex(), reached.hex(), reached == root), strict=True):
                    column.append(value)
            names = [c.split()[0] for c in PROVEN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:6]), pa.array(out[6], pa.bool_())], names=names)

    return leaves.select("key", "digest", "altered", "subroot", "root", "path").mapInArrow(run, PROVEN)


def op12_merkle_manifest(spark, sf_dir):
    """Proofs of all documents in one manifest, with every seventh document tampered with."""
    docs = documents(spark, sf_dir)
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = F.coalesce(F.try_add(F.col("n_chars").cast("long"), F.lit(1)), F.col("n_chars").cast("long"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, row_digest(*own[:3], more, own[4]))
    leaves = docs.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").cast("long").alias("key"), row_digest(*own).alias("digest"), tampered.alias("altered"))
    return proofs(manifest(leaves)).withColumnRenamed("key", "doc_id")


#: The same in DuckDB: all levels, then all paths, one level after the other. CRC-32 is the reflected polynomial 0xEDB88320.
ORACLE = """
    WITH RECURSIVE bits AS (SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
    f AS (SELECT doc_id, lang, n_chars, CAST(doc_id AS VARCHAR) AS key, [CAST(doc_id AS VARCHAR), source, lang] AS head, text FROM documents),
    t AS (SELECT f.*, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 7 = 0, false) AS tampered FROM f, crc),
    e AS (SELECT t.*, array_to_string(list_transform(head, lambda x: coalesce(strlen(x) || ':' || x, '-')), '') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM t),
    h AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
                 sha256(a || coalesce(strlen(CAST(n_chars + CAST(tampered AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(tampered AS INT)), '-') || z) AS altered FROM e),
    o AS (SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM h),
    nodes AS (SELECT grp, 0 AS level, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS n, leaf AS digest FROM o
              UNION ALL SELECT grp, level + 1, idx // 2, (n + 1) // 2, sha256(digest || coalesce(after, '')) FROM (SELECT *, lead(digest) OVER (PARTITION BY grp ORDER BY idx) AS after FROM nodes WHERE n > 1) WHERE idx % 2 = 0),
    sub AS (SELECT grp, level AS height, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS groups FROM nodes WHERE n = 1),
    tops AS (SELECT 0 AS level, CAST(place AS BIGINT) AS idx, CAST(groups AS BIGINT) AS n, subroot AS digest FROM sub
             UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(digest || coalesce(after, '')) FROM (SELECT *, lead(digest) OVER (ORDER BY idx) AS after FROM tops WHERE n > 1) WHERE idx % 2 = 0),
    top AS (SELECT digest AS root, level AS high FROM tops WHERE n = 1),
    fold AS (SELECT row_number() OVER () AS rid, o.doc_id, o.grp, leaf, subroot, height, place, CAST(o.idx AS BIGINT) AS idx, 0 AS level, altered AS cur, '' AS path FROM o JOIN sub USING (grp)
             UNION ALL
             SELECT rid, doc_id, grp, leaf, subroot, height, place, spot // 2, level + 1,
                    CASE WHEN sib IS NULL THEN sha256(cur) WHEN spot % 2 = 0 THEN sha256(cur || sib) ELSE sha256(sib || cur) END, path || coalesce(sib, '')
             FROM (SELECT w.*, coalesce(s.digest, u.digest) AS sib FROM (SELECT *, CASE WHEN level = height THEN place ELSE idx END AS spot FROM fold, top WHERE level < height + high) w
                   LEFT JOIN nodes s ON w.level < height AND s.grp = w.grp AND s.level = w.level AND s.idx = xor(w.spot, 1)
                   LEFT JOIN tops u ON w.level >= height AND u.level = w.level - height AND u.idx = xor(w.spot, 1)))
    SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM fold, top WHERE level = height + high
"""
