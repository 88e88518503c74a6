"""Substring search over stored rows by an index of trigrams, so that a search opens only the blocks that may hold a hit.

Rows are written in blocks of neighbouring ones. The index has, for each run of three characters of the
lower-cased columns, the blocks where it stands. A search looks up the runs of what is asked,
keeps the blocks that have all of them, reads those and compares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 8_192
#: Blocks that are named in the filter of a search; where more may hold a hit, all rows are read and compared.
FEW = 2_000


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, lower-cased; none of a null or shorter one."""
    low = F.lower(text)
    at = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_distinct(F.transform(at, lambda k: F.substr(low, k, F.lit(3)))), F.array().cast("array<string>"))


def write_searchable(rows: DataFrame, path: str, columns: list[str], order: list[str] | None = None, block: int = BLOCK) -> None:
    """Write ``rows``, in ranges of ``order`` if given, and the index of their text ``columns`` under ``path``.

    A block is some ``block`` rows of one task, so files hold runs of blocks. Null texts have no
    runs; repeated rows are kept; an empty table is written as such.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    place = F.monotonically_increasing_id()
    number = F.shiftright(place, 33) * (1 << 20) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / block)
    dealt.withColumn("_block", number).write.parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    found = written.select("_block", F.explode(F.array_distinct(F.concat(*(grams(F.col(c)) for c in columns)))).alias("gram")).distinct()
    found.repartitionByRange("gram").sortWithinPartitions("gram", "_block").write.parquet(f"{path}/grams")


def search(spark: SparkSession, path: str, columns: list[str], asked: str) -> DataFrame:
    """The rows under ``path`` with ``asked`` somewhere in one of ``columns``, whatever the case; all rows of an empty search.

    The blocks that have all the runs of what is asked are looked up first, among files of the index
    that hold those runs, and only they are read. Fewer than three characters have no run, so all rows are compared.
    """
    rows = spark.read.parquet(f"{path}/rows")
    low = asked.lower()
    wanted = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    if wanted:
        blocks = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(wanted)).groupBy("_block").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
        named = [r[0] for r in blocks.select("_block").limit(FEW + 1).collect()]
        rows = rows.filter(F.col("_block").isin(named)) if len(named) <= FEW else rows
    if low:
        hit = F.lit(False)
        for c in columns:
            hit |= F.coalesce(F.contains(F.lower(F.col(c)), F.lit(low)), F.lit(False))
        rows = rows.filter(hit)
    return rows.drop("_block")
