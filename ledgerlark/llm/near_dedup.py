"""Near-duplicates by MinHash, with sequential Bayesian verification of the candidates.

Documents with equal shingle sets form a class and go on as one, under a number of its own: a doc_id
may stand for several texts, so rows are told apart by their doc_id and two hashes of their text. Bands of MinHash values put the
classes into buckets. Candidate pairs compare their signatures batch by batch; a pair is pruned
as soon as its matches so far make a similarity of the threshold or more less probable than the
chosen miss probability, and what survives is verified on the full shingle sets.

Pairs within a bucket are not all listed. First each member meets the bucket's smallest member and
one that a hash picks. Then buckets that still hold several components are dealt into blocks: a
component of a block's size or more has blocks of its own, smaller ones share blocks, and blocks
of one and the same component don't meet. So a bucket of near copies and a few strays costs as
many block pairs as it has blocks. Only pairs of different components that survive leave a block
pair. Where those are more than the blocks have members, the full sets come to the blocks instead,
and only verified links that join components leave.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, hash_words, lower_words_of, mark, mix64, release, saved, slices, small_batches, trimmed, window_hashes

BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
BATCH = 32
BLOCK = 256
#: Shingles that count as one member of a block; a longer document counts as several, so a block's sets take some 16 MB.
MEMBER_SHINGLES = 8_192
DESCRIBED = "doc_id long, text_a long, text_b long, n_shingles long, set_hi long, set_lo long, signature binary, bands array<long>"


@functools.cache
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1), rng.integers(0, 2**64, HASHES, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's ``width``-word shingles; of a shorter text's whole sequence; none without words."""
    words = lower_words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = hash_words(words)
    return np.unique(window_hashes(hashes, min(width, len(words))) ^ np.uint64(min(width, len(words))))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of HASHES hash functions over a set that isn't empty."""
    a, b = _seeds()
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        values = np.multiply.outer(shingles[k : k + 512], a)
        values += b
        np.minimum(low, values.min(axis=0), out=low)
    return low


@functools.cache
def fewest_matches(threshold_percent: int, miss: float) -> np.ndarray:
    """For n = BATCH, 2 * BATCH, ... compared hashes, the fewest matches with which a similarity of the threshold or more is at least as probable as ``miss``.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1) distributed;
    its upper tail at t is the chance of m or fewer successes among n + 1 trials of chance t.
    """
    t, out = threshold_percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, fewest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two equally long signature matrices survive all batches, and their numbers of matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(fewest):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        good = matches >= least
        alive, matches = alive[good], matches[good]
    return alive, matches


def describe(docs: DataFrame, width: int) -> DataFrame:
    """n_shingles, a 128-bit digest of the shingle set, the signature (16 bits a hash) and the band keys of each document."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        offsets = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in slices(batches):
            n, hi, lo, signatures, bands = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                n.append(len(shingles))
                if not len(shingles):
                    hi.append(None), lo.append(None), signatures.append(None), bands.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                hi.append(int.from_bytes(digest[:8], "big", signed=True)), lo.append(int.from_bytes(digest[8:], "big", signed=True))
                low = minhashes(shingles)
                signatures.append((low >> np.uint64(48)).astype("<u2").tobytes())
                keys = window_hashes_by_band(low) + offsets
                bands.append(mix64(keys).view(np.int64))
            lists = pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(signatures, pa.binary()), lists], names=["doc_id", "text_a", "text_b", "n_shingles", "set_hi", "set_lo", "signature", "bands"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_hashes(F.col("text"))).mapInArrow(trimmed(run), DESCRIBED)


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text, text_a and text_b."""
    return F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")


def window_hashes_by_band(low: np.ndarray) -> np.ndarray:
    """One hash for the ROWS values of each band."""
    out = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the nodes of ``edges`` (a, b): the smallest id reachable.

    Each round takes the least component among a node and its neighbours, then the component of
    that component; it ends when nothing changes. State is written to the shared folder each round.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    began, spark = mark(), edges.sparkSession
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("up"))
        moved = saved(low.join(up, "low").select("id", F.least("low", "up").alias("component"), "old"), "labels")
        release(spark, began, (moved,))
        labels = moved.select("id", "component")
        labels._saved_at = moved._saved_at
        if moved.filter("component <> old").isEmpty():
            return labels


def _shingle_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, few: int = 500_000) -> DataFrame:
    """(id, shingles) of the classes in ``ids`` (id), made again from the texts of their heads and written.

    Fewer than ``few`` (16 MB at the default) are broadcast to the texts; for more, they and the texts are shuffled.
    """

    def sets(batches):
        import pyarrow as pa

        for batch in slices(batches):
            made = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "shingles"])

    wanted = saved(classes.select(F.col("node").alias("id"), "head.*").join(ids, "id", "left_semi"), "wanted")
    small = wanted.count() < few
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes(F.col("text")), "text")
    texts = texts.join(F.broadcast(wanted) if small else wanted, ["doc_id", "text_a", "text_b"]).select("id", "text")
    return saved(texts.mapInArrow(trimmed(sets), "id long, shingles binary").dropDuplicates(["id"]), "shingles")


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids (id) of ``pairs`` (a, b)."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets, from ``sets`` (id, shingles), are similar enough."""

    def compare(batches):
        import pyarrow as pa

        for batch in slices(batches):
            left, right = (c.to_pylist() for c in batch.columns[2:])
            keep = pa.array([linked_sets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(trimmed(compare), "a long, b long")


def linked_sets(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = len(u) + len(v) - len(np.union1d(u, v))
    return 100 * both >= percent * (len(u) + len(v) - both)


class BlockPair:
    """Two blocks of one bucket, whose members are compared with each other; or a block and itself."""

    def __init__(self, row: dict, percent: int):
        self.row, sides = row, "ab"
        self.ids, self.components, sizes = ([np.array(row[f"{k}_{s}"], np.int64) for s in sides] for k in ("ids", "components", "sizes"))
        self.signatures = [np.frombuffer(b"".join(row[f"signatures_{s}"]), "<u2").reshape(-1, HASHES) for s in sides]
        bands = [np.array(row[f"bands_{s}"], np.int64).reshape(-1, BANDS) for s in sides]
        apart = self.components[0][:, None] != self.components[1][None, :]
        apart &= 100 * np.minimum.outer(*sizes) >= percent * np.maximum.outer(*sizes)
        apart &= (self.ids[0][:, None] != row["first_a"]) & (self.ids[1][None, :] != row["first_a"])
        if (row["owner_a"], row["chunk_a"]) == (row["owner_b"], row["chunk_b"]):
            apart &= self.ids[0][:, None] < self.ids[1][None, :]
        column = int(np.flatnonzero(bands[0][0] == row["band"])[0])
        for k in range(column):  # two documents that share several buckets are compared in the first
            apart &= bands[0][:, k][:, None] != bands[1][:, k][None, :]
        self.pairs = np.nonzero(apart)

    def candidates(self, fewest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of either block, and matches, of the pairs that survive."""
        found = []
        for k in range(0, len(self.pairs[0]), 1 << 15):
            x, y = (p[k : k + (1 << 15)] for p in self.pairs)
            alive, matches = survivors(self.signatures[0][x], self.signatures[1][y], fewest)
            found.append((x[alive], y[alive], matches))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3

    def links(self, fewest: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Links, verified on the full sets, that join all components which any surviving pair links; the likeliest pairs first."""
        sets = [[np.frombuffer(x, np.uint64) for x in self.row[f"shingles_{s}"]] for s in "ab"]
        root, out = {}, []

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        x, y, matches = self.candidates(fewest)
        for k in np.argsort(-matches, kind="stable"):
            i, j = x[k], y[k]
            one, other = find(self.components[0][i]), find(self.components[1][j])
            if one != other and linked_sets(sets[0][i], sets[1][j], percent):
                root[max(one, other)] = min(one, other)
                out.append((int(self.ids[0][i]), int(self.ids[1][j])))
        return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked with, over any number of links) and kept (it is that one).

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles
    (A-Z lower-cased; fewer words make one shingle) is ``percent`` per cent or more. ``miss`` is
    the probability with which each of the HASHES / BATCH batches of the signature comparison may
    prune such a pair; at 80 per cent the bands miss one with probability 6e-5, at 85 per cent
    with 1e-7.

    Documents without words, null texts among them, are linked with nothing. Rows with a null
    doc_id are linked with nothing, have a null component_id and are kept. Repeated rows have
    equal sets, so they share a component. Rows of one doc_id with different texts are documents
    of their own: each has the component of its text. Of very long texts the whole set is compared,
    made in one task each. Ties (equal sets) go to the smallest doc_id. Other columns, whatever their
    names, are not read. An empty table gives no rows.

    Texts are read once for the signatures and once for the candidates' sets, and shuffled only
    where there are half a million candidates; a third time for members of blocks that were no candidates before.
    """
    return _judged(docs, width, percent, miss).drop("text_a", "text_b")


def unique_documents(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of ``docs``, with all their columns, that near_duplicates() keeps.

    A row is judged by its doc_id and text, so rows with the doc_id of a dropped one but another
    text stay, and so do repeated rows of a kept one. Up to 500,000 dropped texts (16 MB) are
    broadcast; of more, they and the rows are shuffled.
    """
    dropped = _judged(docs, width, percent, miss).filter("NOT kept").select("doc_id", "text_a", "text_b").distinct()
    dropped = saved(dropped.toDF("_dropped", "_dropped_a", "_dropped_b"), "dropped")
    few = dropped.count() <= 500_000
    a, b = text_hashes(docs["text"])
    same = (docs["doc_id"].cast("long") == dropped["_dropped"]) & (a == dropped["_dropped_a"]) & (b == dropped["_dropped_b"])
    return docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")


def _judged(docs: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """What near_duplicates() returns, and the hashes of each row's text."""
    began = mark()
    described = saved(describe(docs, width), "signatures")
    usable = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    head = F.min(F.struct("doc_id", "text_a", "text_b")).alias("head")
    classes = saved(usable.groupBy("set_hi", "set_lo").agg(head).withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = ["set_hi", "set_lo", "doc_id", "text_a", "text_b"]
    heads = usable.join(classes.select("set_hi", "set_lo", "head.*", "node"), keys).dropDuplicates(["node"])
    heads = saved(heads.select(F.col("node").alias("id"), "n_shingles", "signature", "bands"), "heads")
    members = heads.select("id", "n_shingles", F.explode("bands").alias("band"))
    by_hash = F.struct(F.xxhash64("id", "band"), "id")
    buckets = saved(members.groupBy("band").agg(F.min("id").alias("first"), F.min(by_hash)["id"].alias("other"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = saved(members.join(buckets, "band"), "members")

    met = _met(heads, members, percent, miss)
    sets = _shingle_sets(docs, classes, _ends(met), width)
    links = saved(_verified(met, sets, percent), "verified")
    labels = components(links)
    more, dense = _across(heads, members, labels, percent, miss)
    in_blocks = saved(dense.select(*_SIDES["a"], F.explode("ids_a").alias("id")).union(dense.select(*_SIDES["b"], F.explode("ids_b"))).distinct(), "dense-members")
    new = saved(_ends(more).union(in_blocks.select("id")).distinct().join(sets.select("id"), "id", "left_anti"), "new")
    if not new.isEmpty():
        sets = sets.union(_shingle_sets(docs, classes, new, width))
    found = [f for pairs, f in ((more, _verified(more, sets, percent)), (dense, _within(dense, in_blocks, sets, percent, miss))) if not pairs.isEmpty()]
    if found:
        extra = saved(functools.reduce(DataFrame.union, found), "verified")
        labels = components(links.union(extra)) if not extra.isEmpty() else labels
    least = classes.select(F.col("node").alias("id"), "head.doc_id").join(labels, "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    lowest = saved(labels.join(least, "component").select(F.col("id").alias("node"), "least"), "lowest")
    release(docs.sparkSession, began, (described, classes, lowest))

    joined = classes.join(lowest, "node", "left").select("set_hi", "set_lo", F.coalesce("least", "head.doc_id").alias("class_component"))
    placed = described.select("doc_id", "text_a", "text_b", "n_shingles", "set_hi", "set_lo").join(joined, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return placed.select("doc_id", "text_a", "text_b", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _met(heads: DataFrame, members: DataFrame, percent: int, miss: float, likeliest: int = 4) -> DataFrame:
    """Surviving pairs of each member with its buckets' smallest members, and with the ``likeliest`` of the members that a hash picks in each bucket."""
    fewest = fewest_matches(percent, miss)

    def prune(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, HASHES) for k in (3, 4))
            alive, matches = survivors(a, b, fewest)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(alive)) for k in range(3)), pa.array(matches, pa.int32())], names=["a", "b", "first", "matches"])

    pairs = [members.filter(F.col("id") != F.col(c)).select(F.col(c).alias("a"), F.col("id").alias("b"), F.lit(c == "first").alias("first")) for c in ("first", "other")]
    pairs = pairs[0].union(pairs[1]).groupBy("a", "b").agg(F.max("first").alias("first"))
    left, right = (heads.select(F.col("id").alias(c), F.col("signature").alias(f"s_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    alive = pairs.join(right, "b").join(left, "a").filter(fits).select("a", "b", "first", "s_a", "s_b").mapInArrow(trimmed(prune), "a long, b long, first boolean, matches int")
    ranked = alive.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("matches"), "a")))
    return saved(ranked.filter(F.col("first") | (F.col("rank") <= likeliest)).select("a", "b"), "candidates")


#: What names a block: its bucket, the component that it is a part of (SHARED if of several) and its number. And the payload of a block.
_BLOCK = ("band", "owner", "chunk")
_SIDES = {"a": ("band", "owner_a", "chunk_a"), "b": ("band", "owner_b", "chunk_b")}
_LISTS = {"ids": "id", "components": "component", "sizes": "n_shingles", "signatures": "signature", "bands": "bands"}
SHARED = -(1 << 63)


def _side(blocks: DataFrame, side: str, *columns: str) -> DataFrame:
    """``blocks`` with its columns but ``band`` named for one side of a pair."""
    return blocks.select("band", *(F.col(c).alias(f"{c}_{side}") for c in ("owner", "chunk", *columns)))


def block_pairs(cells: DataFrame) -> DataFrame:
    """The pairs (band, owner_a, chunk_a, owner_b, chunk_b) of blocks of a bucket that may hold different components.

    Shared blocks meet each other, themselves and the components' own blocks; blocks of one
    component meet those of another. Only names of blocks are joined, and no pair is made that
    isn't needed.
    """
    shared, owned = cells.filter(F.col("owner") == SHARED), cells.filter(F.col("owner") != SHARED)
    among = _side(shared, "a").join(_side(shared, "b"), "band").filter("chunk_a <= chunk_b")
    beside = _side(shared, "a").join(_side(owned, "b"), "band")
    owners = owned.select("band", "owner").distinct()
    two = owners.select("band", F.col("owner").alias("owner_a")).join(owners.select("band", F.col("owner").alias("owner_b")), "band").filter("owner_a < owner_b")
    apart = two.join(_side(owned, "a"), ["band", "owner_a"]).join(_side(owned, "b"), ["band", "owner_b"])
    return functools.reduce(DataFrame.unionByName, (among, beside, apart))


def _with_blocks(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``pairs`` with both blocks' payloads, and the bucket's first member (``first_a``)."""
    return pairs.join(_side(blocks, "a", "first", *_LISTS), list(_SIDES["a"])).join(_side(blocks, "b", *_LISTS), list(_SIDES["b"]))


def _across(heads: DataFrame, members: DataFrame, labels: DataFrame, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """What is left to compare in buckets that hold several components: surviving pairs (a, b), and the pairs of blocks with more of them than members."""
    fewest = fewest_matches(percent, miss)
    labelled = members.select("id", "n_shingles", "band", "first").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    weight = F.greatest(F.lit(1), F.ceil(F.col("n_shingles") / MEMBER_SHINGLES))
    shares = saved(labelled.groupBy("band", "component").agg(F.sum(weight).alias("n_own")), "shares")
    small = F.sum(F.when(F.col("n_own") < BLOCK, F.col("n_own")).otherwise(0))
    split = shares.groupBy("band").agg(F.count("*").alias("parts"), small.alias("n_small")).filter("parts > 1").select("band", "n_small")
    dealt = shares.join(split, "band").withColumn("owner", F.when(F.col("n_own") < BLOCK, F.lit(SHARED)).otherwise(F.col("component")))
    dealt = dealt.withColumn("chunks", F.ceil(F.when(F.col("owner") == SHARED, F.col("n_small")).otherwise(F.col("n_own")) / BLOCK)).select("band", "component", "owner", "chunks")
    rest = labelled.join(dealt, ["band", "component"]).join(heads.select("id", "signature", "bands"), "id")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    blocks = saved(rest.groupBy("band", "owner", chunk.alias("chunk"), "first").agg(*(F.collect_list(c).alias(k) for k, c in _LISTS.items())), "blocks")
    pairs = saved(block_pairs(blocks.select(*_BLOCK)), "block-pairs")

    names = {"a": "bigint", "b": "bigint", "band": "bigint", "owner_a": "bigint", "chunk_a": "int", "owner_b": "bigint", "chunk_b": "int"}

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 4):
            rows = []
            for row in batch.to_pylist():
                pair = BlockPair(row, percent)
                x, y, _ = pair.candidates(fewest)
                if len(x) > len(pair.ids[0]) + len(pair.ids[1]):
                    rows.append((None, None, *(row[c] for c in list(names)[2:])))
                else:
                    rows += [(min(a, b), max(a, b), *[None] * 5) for a, b in zip(pair.ids[0][x].tolist(), pair.ids[1][y].tolist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, t in zip(columns, names.values(), strict=True)], names=list(names))

    found = saved(_with_blocks(pairs, blocks).mapInArrow(trimmed(run), ", ".join(f"{c} {t}" for c, t in names.items())), "candidates")
    dense = saved(found.filter("band IS NOT NULL").drop("a", "b"), "dense-pairs")
    return found.filter("band IS NULL").select("a", "b").distinct(), _with_blocks(dense, blocks)


def _within(dense: DataFrame, members: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Verified links (a, b) within pairs of blocks: the full sets of their ``members`` are brought to the blocks, and only links that join components leave them."""
    fewest = fewest_matches(percent, miss)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            found = [link for row in batch.to_pylist() for link in BlockPair(row, percent).links(fewest, percent)]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    members = members.toDF(*_BLOCK, "id")
    known = saved(members.join(sets, "id").groupBy(*_BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("id", "shingles"))).alias("sets")), "dense-sets")
    for s in "ab":
        dense = dense.join(_side(known, s, "sets").withColumnRenamed(f"sets_{s}", "sets"), list(_SIDES[s]))
        dense = dense.withColumn(f"shingles_{s}", F.transform(f"ids_{s}", lambda i: F.element_at("sets", i))).drop("sets")
    return dense.mapInArrow(trimmed(run), "a long, b long")


def op1_near_duplicates(spark, sf_dir):
    """Components of all documents by 2-word shingles at 80 per cent."""
    return near_duplicates(documents(spark, sf_dir), width=2)


#: The same in DuckDB, by comparing all pairs of rows that share a shingle.
ORACLE = """
    WITH RECURSIVE w AS (
      SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT rid, doc_id IS NOT NULL AS known, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle FROM w),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    t AS (SELECT s.rid, shingle, n FROM s JOIN n USING (rid) WHERE known),
    p AS (SELECT a.rid AS x, b.rid AS y, any_value(a.n) + any_value(b.n) AS sizes, count(*) AS shared
          FROM t a JOIN t b ON a.shingle = b.shingle AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
    e AS (SELECT x, y FROM p WHERE 100 * shared >= 80 * (sizes - shared)),
    links AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r AS (SELECT x AS rid, x AS reached FROM links UNION SELECT r.rid, links.y FROM r JOIN links ON r.reached = links.x),
    c AS (SELECT r.rid, min(o.doc_id) AS low FROM r JOIN w o ON o.rid = r.reached GROUP BY r.rid)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, w.doc_id) AS component_id, coalesce(coalesce(c.low, w.doc_id) = w.doc_id, true) AS kept
    FROM w LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)
"""
