"""Places of rows in their groups' order, where a group may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.scratch import saved


def ranked(rows: DataFrame, by: str, order: str, few: int = 100_000) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 in the ascending order of ``order`` within their group ``by``, and ``n``, the group's size.

    Rows are dealt by ranges of (by, order) and their number in the table, so equal rows are spread
    as well and no group is one task. Each range knows its groups' places once the counts of the
    ranges before it are added up; up to ``few`` of these counts are broadcast. Null groups and
    values come first, ties in any order. The rows are written once.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [by, order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = saved(dealt.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranked")
    runs = placed.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("_by").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_by", "_in", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("_by")).alias("n"))
    runs = saved(runs, "runs")
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_in"))
    joined = placed.join(F.broadcast(runs) if runs.count() <= few else runs, same)
    return joined.withColumn("rank", F.col("_start") + F.col("_place") - F.col("_first")).drop("_part", "_place", "_by", "_in", "_first", "_start")
