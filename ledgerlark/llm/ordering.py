"""Rows in ascending order of a key, each beside the row after it, with one shuffle of the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import slices


def with_successors(docs: DataFrame, parts_per_task: int = 4) -> DataFrame:
    """(part, tail, doc_id, text) such that within a task the rows of each part come in ascending doc_id order, and then the tail: the first row of the next part.

    The last part's tail is the table's first row. Null doc_ids come first; rows with equal
    doc_ids go by a hash of their texts. Parts are cut at approximate percentiles of doc_id that
    are doc_ids themselves, so the only things gathered are as many numbers as there are parts, and
    neighbouring parts go to a task together, as many to each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = tasks * parts_per_task
    found = rows.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)] or [0.5], 10 * wanted).alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts = np.array(sorted({found.low, *found.cuts}) if found.low is not None else [], np.int64)
    first_id, last = (None if found.nulls or not len(cuts) else int(cuts[0])), max(0, len(cuts) - 1)

    @F.pandas_udf("int")
    def part_of(ids):
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.maximum(0, np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), side="right") - 1)
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def heads_part(ids):
        return ids.isin(cuts[1:])

    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("tail"))
    before = F.when(F.col("_head"), F.struct((F.col("_part") - 1).alias("part"), F.lit(True).alias("tail")))
    is_first = F.col("doc_id").eqNullSafe(F.lit(first_id).cast("long"))
    end = F.when(is_first, F.struct(F.lit(last).alias("part"), F.lit(True).alias("tail")))
    placed = rows.withColumn("_part", part_of("doc_id")).withColumn("_head", F.coalesce(heads_part("doc_id"), F.lit(False)))
    placed = placed.withColumn("_at", F.explode(F.array_compact(F.array(own, before, end))))
    dealt = placed.select("_at.part", "_at.tail", "doc_id", "text").repartitionByRange(tasks, "part")
    return dealt.sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), F.xxhash64("text"))


def successive(batches):
    """From batches of with_successors(), (doc_id, text, next_text) of each row."""
    held = None
    for batch in slices(batches):
        for part, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[0] == part:
                yield held[1], held[2], text
            held = None if tail else (part, doc_id, text)
