"""Joins that SQL has no single operator for: as-of, roster lookup with fallbacks, new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import blank_to_null, canonical_name, first_last_key, without_initial


def asof_join(left: DataFrame, right: DataFrame, by: str, left_day: str, right_day: str, value: str, out_day: str, out_value: str, period: str = "MM") -> DataFrame:
    """``left`` with the last ``right`` row of the same ``by`` on or before ``left_day``: its day as ``out_day`` and its value as ``out_value``; null if there is none.

    Rows are sorted within (by, period), so one key with most of the rows is spread over its
    months; null keys and days find nothing. Into each period goes the last row of the periods before it, found among one row per
    key and period. Of several right rows on one day the largest value counts.
    """
    entry = F.struct(F.col(right_day).alias("day"), F.col(value).alias("value"))
    right = right.filter(F.col(by).isNotNull() & F.col(right_day).isNotNull())
    known = right.groupBy(F.col(by).alias("_by"), F.trunc(right_day, period).alias("_period")).agg(F.max(entry).alias("_last"))
    asked = left.select(F.col(by).alias("_by"), F.trunc(left_day, period).alias("_period")).distinct()
    before = Window.partitionBy("_by").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select("_by", "_period", "_last").unionByName(asked, allowMissingColumns=True).groupBy("_by", "_period").agg(F.max("_last").alias("_last"))
    carried = carried.select("_by", "_period", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    rows = left.withColumns({"_by": F.col(by), "_day": F.col(left_day), "_asks": F.lit(True), "_entry": F.lit(None).cast(f"struct<day:{dict(right.dtypes)[right_day]},value:{dict(right.dtypes)[value]}>")})
    facts = right.select(F.col(by).alias("_by"), F.col(right_day).alias("_day"), F.lit(False).alias("_asks"), entry.alias("_entry"))
    both = rows.unionByName(facts, allowMissingColumns=True).withColumn("_period", F.trunc("_day", period))
    upto = Window.partitionBy("_by", "_period").orderBy("_day", "_asks", "_entry").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_entry", ignorenulls=True).over(upto)).filter("_asks")
    found = found.join(carried, ["_by", "_period"], "left").withColumn("_found", F.coalesce("_found", "_carry"))
    return found.select(*left.columns, F.col("_found.day").alias(out_day), F.col("_found.value").alias(out_value))


def latest_values(right: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """The last day and its value for each key."""
    return right.groupBy(by).agg(F.max(day).alias("asof_date"), F.max_by(value, day).alias("asof_value"))


def roster_index(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roster by canonical key, and by first-and-last key; of members with one key the first stays.

    ``members``: name, chamber, party, state, district, aliases and position in the roster.
    """
    aliases = F.coalesce("aliases", F.expr("CAST(array() AS array<string>)"))
    names = members.select("*", F.posexplode(F.concat(F.array("name"), aliases)).alias("_pos", "_alias"))
    keyed = names.withColumn("exact", canonical_name("_alias")).withColumn("loose", first_last_key("exact"))
    entry = F.struct("position", "_pos", "name", "chamber", "party", "state", "district")
    return tuple(keyed.groupBy(F.col(k).alias("key")).agg(F.min(entry).alias("entry")) for k in ("exact", "loose"))


def roster_lookup(rows: DataFrame, members: DataFrame, name: str = "member", chamber: str | None = "chamber") -> DataFrame:
    """``rows`` with a column ``found``: the roster entry of ``name``, or null.

    Tried in turn: the canonical name, its first and last word, and both again without a leading
    initial. The first hit decides: if its chamber is known and another, the name isn't found.
    """
    exact, loose = roster_index(members)
    keyed = rows.withColumn("_k0", canonical_name(name)).withColumn("_k2", without_initial("_k0"))
    keyed = keyed.withColumns({"_k1": first_last_key("_k0"), "_k3": first_last_key("_k2")})
    for k, index in enumerate((exact, loose, exact, loose)):
        keyed = keyed.join(index.select(F.col("key").alias(f"_k{k}"), F.col("entry").alias(f"_e{k}")), f"_k{k}", "left")
    hit = F.coalesce(*(f"_e{k}" for k in range(4)))
    if chamber is not None:
        other = F.coalesce(hit["chamber"] != F.col(chamber), F.lit(False))
        hit = F.when(~other, hit)
    return keyed.withColumn("found", hit).select(*rows.columns, "found")


def enrich(trades: DataFrame, members: DataFrame) -> DataFrame:
    """Trades with the roster's name, and its party, state and district where it has them."""
    found = roster_lookup(trades, members)
    fill = {c: F.coalesce(blank_to_null(F.col(f"found.{c}")), F.col(c)) for c in ("party", "state", "district")}
    return found.withColumns(fill | {"member": F.coalesce("found.name", "member")}).select(trades.columns)


def new_rows(candidates: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose keys aren't among the processed ones."""
    return candidates.join(processed.select(keys).distinct(), keys, "left_anti")
