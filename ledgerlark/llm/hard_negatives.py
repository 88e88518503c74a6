"""Hard-negative mining by bit-sliced integer products.

Vectors are integers, and a vector is a stack of bit planes: its sign plane and one for each power of
two. The product with an anchor is the sum over planes, each weighted by its power, so after the
most significant ones it lies in an interval: what is known, and what the lower planes can still add,
between the sum of the anchor's negative and that of its positive components times the powers left.
Plane by plane the intervals tighten, and a candidate that can no longer qualify is dropped; only
those that stay get their lower planes, and at the last plane the interval is the exact score.

Anchors and rows meet in blocks of rows by blocks of anchors, each a group of its own, whose sizes
don't grow with the table. A block pair returns a few rows for each anchor, which a window over
the anchor ranks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import mark, release, saved

#: Rows and anchors of a block: what a task holds, however many rows the table has.
BLOCK_ROWS, BLOCK_ANCHORS = 8_192, 1_024
#: Rows of a block that are multiplied at a time, with all anchors of the other: 16 MB of doubles.
SLICE = 2_048
#: Up to this, sums of products and the ends of their intervals are exact as doubles.
EXACT = 1 << 50


def integers(vector: Column, scale: int = 256) -> Column:
    """The components of a vector as integers, floor(scale * x); null if it or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale)))


class Planes:
    """Rows of integers as bit planes of two's complement, the most significant (the sign's) first."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.bits = rows, max(int(rows.max(initial=0)), -int(rows.min(initial=0)) - 1).bit_length() + 1

    def plane(self, k: int, which=slice(None)) -> np.ndarray:
        """Bit ``k`` of rows, as 0 and 1."""
        return ((self.rows[which] >> k) & 1).astype(np.float64 if self.rows.dtype != object else object)


def scored(planes: Planes, anchors: np.ndarray, open_: np.ndarray, worth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs that are open in ``open_`` (rows x anchors) and stay so.

    ``worth(low, high)`` tells for intervals (rows x anchors, or as flat pairs with the numbers of
    their anchors as third argument) which pairs may still qualify. Planes are multiplied for all
    pairs at once as long as one in 64 is open, and pair by pair from then on.
    """
    exact = object if anchors.dtype == object or planes.rows.dtype == object else np.float64
    a = anchors.astype(exact)
    below, above = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    known = np.zeros(open_.shape, exact)
    k = planes.bits - 1
    while k >= 0 and 64 * np.count_nonzero(open_) > open_.size:
        known = known + (planes.plane(k) @ a.T) * (-(1 << k) if k == planes.bits - 1 else 1 << k)
        rest = (1 << k) - 1
        open_ = open_ & worth(known + rest * below, known + rest * above, None)
        k -= 1
    row, anchor = np.nonzero(open_)
    known = known[row, anchor]
    while k >= 0 and len(row):
        weight, rest = -(1 << k) if k == planes.bits - 1 else 1 << k, (1 << k) - 1
        part = np.zeros(len(row), exact)
        for at in range(0, len(row), 1 << 14):
            s = slice(at, at + (1 << 14))
            part[s] = (planes.plane(k, row[s]) * a[anchor[s]]).sum(axis=1)
        known = known + weight * part
        stays = worth(known + rest * below[anchor], known + rest * above[anchor], anchor)
        row, anchor, known = row[stays], anchor[stays], known[stays]
        k -= 1
    return row, anchor, known


def _matrix(column, n: int) -> np.ndarray:
    """Arrow lists of equal length as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _sliced(rows, anchors):
    """(first row, planes, anchors) of slices of a block of rows; as Python's integers where doubles may not be exact."""
    x, a = _matrix(rows.column("vector"), rows.num_rows), _matrix(anchors.column("vector"), anchors.num_rows)
    largest = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (x, a)]
    if x.shape[1] * largest[0] * largest[1] > EXACT:
        x, a = x.astype(object), a.astype(object)
    for at in range(0, len(x), SLICE):
        yield at, Planes(x[at : at + SLICE]), a


def _first(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` best places: highest score first, ties by smaller id."""
    return np.lexsort((ids, -scores))[:most]


def _in_blocks(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` for each block of anchors and each block of rows (and for each length of vectors, as only equal ones have a product)."""
    n_rows, n_anchors = (max(1, -(-df.count() // size)) for df, size in ((rows, BLOCK_ROWS), (anchors, BLOCK_ANCHORS)))
    sides = []
    for df, own, other, n, m in ((anchors, "_anchors", "_rows", n_anchors, n_rows), (rows, "_rows", "_anchors", n_rows, n_anchors)):
        dealt = df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
        dealt = dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("_size", F.size("vector"))
        sides.append(dealt.select(*(F.col(c).alias(c) for c in dealt.columns)))  # new columns: both sides may come from one table
    keys = ["_size", "_anchors", "_rows"]
    return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(run, schema)


POSITIVE = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long"


def _best_of(planes: Planes, anchors: np.ndarray, open_: np.ndarray, most: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of open pairs, with the ``most`` highest scores of each anchor and all ties among them; rows counted from ``start``."""
    least = np.full(len(anchors), -np.inf, anchors.dtype if anchors.dtype == object else np.float64)

    def worth(low, high, anchor):
        if anchor is None:  # what ends below the most-th highest lower end of an anchor's pairs isn't among its best
            ends = np.where(open_, low, -np.inf)
            if len(ends) >= most:
                least[:] = np.sort(ends, axis=0)[-most] if ends.dtype == object else np.partition(ends, -most, axis=0)[-most]
            return high >= least
        return high >= least[anchor]

    row, anchor, score = scored(planes, anchors, open_, worth)
    return row + start, anchor, score


def _positives(anchors: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """POSITIVE: for each anchor the ``most`` best other rows of its label."""

    def run(left, right):
        import pyarrow as pa

        found = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            labels, own = (t.column("label").to_numpy() for t in (right, left))
            row_of, anchor_of = (t.column("row").to_numpy() for t in (right, left))
            ids, anchor_ids = (t.column("id").to_numpy() for t in (right, left))
            kept = []
            for start, planes, a in _sliced(right, left):
                here = slice(start, start + len(planes.rows))
                same = (labels[here, None] == own[None, :]) & (row_of[here, None] != anchor_of[None, :])
                kept.append(_best_of(planes, a, same, most, start))
            row, anchor, score = (np.concatenate(c) for c in zip(*kept, strict=True))
            for k, at in _by_anchor(anchor):
                best = at[_first(ids[row[at]], score[at], most)]
                for column, values in zip(found, (anchor_of[[k]].repeat(len(best)), anchor_ids[[k]].repeat(len(best)), row_of[row[best]], ids[row[best]], score[best]), strict=True):
                    column += [int(v) for v in values]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in found], names=[c.split()[0] for c in POSITIVE.split(", ")])

    met = _in_blocks(anchors, rows, run, POSITIVE)
    best = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    return met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)


def _by_anchor(anchor: np.ndarray):
    """(anchor, places of it) of each number in ``anchor``."""
    order = np.argsort(anchor, kind="stable")
    cuts = np.flatnonzero(np.diff(anchor[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(anchor[at[0]]), at


NEGATIVE = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, negative_id long, negative_score long"


def _negatives(anchors: DataFrame, rows: DataFrame, most: int, percent: int) -> DataFrame:
    """NEGATIVE: for each positive of an anchor (``positives``: structs of its row, id and score) the ``most`` best rows of other labels between ``percent`` per cent of its score and its score."""

    def run(left, right):
        import pyarrow as pa

        found = [[] for _ in NEGATIVE.split(", ")]
        if left.num_rows and right.num_rows:
            labels, own = (t.column("label").to_numpy() for t in (right, left))
            ids, anchor_of, anchor_ids = right.column("id").to_numpy(), left.column("row").to_numpy(), left.column("id").to_numpy()
            positives = left.column("positives").to_pylist()
            # a score below 0 has no room: percent per cent of it are more than itself
            scores = [sorted(p["score"] for p in x if p["score"] >= 0) for x in positives]
            high_end = np.array([x[-1] if x else -1 for x in scores])
            low_end = np.array([-(-percent * x[0] // 100) if x else 0 for x in scores])

            def worth(low, high, anchor):
                which = slice(None) if anchor is None else anchor
                return (high >= low_end[which]) & (low <= high_end[which])

            kept = []
            for start, planes, a in _sliced(right, left):
                differs = (labels[start : start + len(planes.rows), None] != own[None, :]) & (high_end >= low_end)[None, :]
                row, anchor, score = scored(planes, a, differs, worth)
                kept.append((row + start, anchor, score))
            row, anchor, score = (np.concatenate(c) for c in zip(*kept, strict=True))
            for k, at in _by_anchor(anchor):
                for p in positives[k]:
                    fits = at[(100 * score[at] >= percent * p["score"]) & (score[at] <= p["score"])]
                    for i in fits[_first(ids[row[fits]], score[fits], most)]:
                        for column, value in zip(found, (anchor_of[k], anchor_ids[k], p["row"], p["id"], p["score"], ids[row[i]], score[i]), strict=True):
                            column.append(int(value))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in found], names=[c.split()[0] for c in NEGATIVE.split(", ")])

    return _in_blocks(anchors, rows, run, NEGATIVE)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors in ``rows`` (id, label, vector of integers, is_anchor).

    An anchor's positives are the ``positives`` rows of its label with the highest products with
    it, itself left out; the negatives of a positive are the ``negatives`` highest rows of other
    labels with products from ``percent`` per cent of the positive's to all of it. Ties go to the
    smaller id; an anchor or positive with nothing to return has no row.

    Rows with a null id, label or vector take no part. Repeated rows and ids are rows of their own:
    an anchor's copy may be its positive. Vectors of different lengths have no product and don't
    meet; those of no components all have the product 0. Very long vectors are as good as short ones.
    An empty table, or one without anchors, gives no rows; other columns, whatever their names, are
    not read. Scores must fit into 64 bits; larger ones raise an error.

    Every anchor meets every row, in block pairs; a label or a vector that most rows have makes no
    block larger. Each pair of blocks returns ``positives`` (times ``negatives``) rows for an anchor at most.
    """
    spark, began = rows.sparkSession, mark()
    usable = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    known = saved(usable.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor")), "vectors")
    anchors = known.filter("is_anchor").drop("is_anchor")
    one = F.struct(F.col("positive_row").alias("row"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    chosen = _positives(anchors, known.drop("is_anchor"), positives).groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(one).alias("positives"))
    with_positives = saved(anchors.join(chosen, "row"), "anchors")
    met = _negatives(with_positives, known.drop("is_anchor"), negatives, percent)
    best = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id")
    ranked = saved(met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives), "negatives")
    release(spark, began, (ranked,))
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector, with a seventh of the labels wrong."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table.select(F.col("vec_id").alias("id"), label.alias("label"), integers(F.col("embedding")).alias("vector"), (F.col("vec_id") % 100 == 0).alias("is_anchor")))


#: The same in DuckDB, by all products.
ORACLE = """
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.rid AS ar, a.vec_id AS anchor_id, b.rid AS br, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
          FROM v a JOIN v b ON a.rid <> b.rid AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5),
    n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id) AS rank
          FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
