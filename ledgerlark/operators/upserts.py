"""Keeping a table by key: last write wins, expiry, change detection, merge of rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """``stored`` with the ``incoming`` rows of the same keys in place of its own.

    Of several incoming rows of a key the one with the largest ``sequence`` stays. Rows are
    combined before the shuffle, so a key written often costs no more than one written once.
    """
    columns = [F.col(c) for c in stored.columns]
    ranked = stored.withColumn("_rank", F.struct(F.lit(0).alias("in"), F.lit(None).cast("long").alias("seq")))
    newer = incoming.withColumn("_rank", F.struct(F.lit(1).alias("in"), F.col(sequence).cast("long") if sequence else F.lit(0).cast("long")).cast("struct<in:int,seq:bigint>"))
    both = ranked.select(*columns, "_rank").union(newer.select(*columns, "_rank"))
    last = both.groupBy(keys).agg(F.max_by(F.struct(*columns), "_rank").alias("_row"))
    return last.select("_row.*")


def expire(rows: DataFrame, cutoff, day: str = "filing_date") -> DataFrame:
    """Rows from ``cutoff`` on."""
    return rows.filter(F.col(day) >= F.lit(cutoff).cast("date"))


def content_digest(rows: DataFrame) -> DataFrame:
    """One row (n, digest) that is the same for the same rows in any order, repeats counted.

    A hash passes over nulls, so each column is hashed with whether it is null; one that may hold nulls within goes in as JSON.
    """
    parts = []
    for f in rows.schema:
        column = F.col(f"`{f.name}`")
        parts += [column.isNull(), column] if isinstance(f.dataType, AtomicType) else [F.to_json(F.struct(column))]
    h = F.xxhash64(*parts)
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("digest"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mix"))


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two tables of one schema differ as multisets."""
    return content_digest(before).first() != content_digest(after.select(before.columns)).first()


def merge_rosters(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new roster with the old one's aliases added, and the old members that the new one lacks."""
    held = old.select("name", F.col("aliases").alias("_old"))
    none = F.expr("CAST(array() AS array<string>)")
    aliases = F.array_sort(F.array_remove(F.array_union(F.coalesce("aliases", none), F.coalesce("_old", none)), F.col("name")))
    merged = new.join(held, "name", "left").withColumn("aliases", aliases).drop("_old")
    return merged.unionByName(old.join(new.select("name"), "name", "left_anti"), allowMissingColumns=True)
