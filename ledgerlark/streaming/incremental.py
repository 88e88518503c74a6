"""The disclosure table kept up to date: new filings in, enriched trades out, by batch or by stream.

A dataset is a folder of versions, each with the Parquet tables trades, skipped_filings, processed
and meta. A version counts once its meta is written, so a run that dies leaves the last one whole,
and running it again gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import prune_cutoff
from ledgerlark.operators.filings import TRADE_COLUMNS
from ledgerlark.operators.joins import enrich, new_rows, roster_lookup
from ledgerlark.operators.scratch import mark, release, saved
from ledgerlark.operators.upserts import changed, expire, upsert
from ledgerlark.sources.readers import META_SCHEMA, PROCESSED_SCHEMA, SKIP_SCHEMA, TRADE_SCHEMA, children, exists, remove

TABLES = {"trades": TRADE_SCHEMA, "skipped_filings": SKIP_SCHEMA, "processed": PROCESSED_SCHEMA, "meta": META_SCHEMA}
FILING_KEYS = ["chamber", "filing_id"]


@dataclass
class RunResult:
    """What a run did."""

    changed: bool
    fetched: int = 0
    new_trades: int = 0
    paper_skips: int = 0
    parse_errors: int = 0
    recovered_errors: int = 0
    pruned_trades: int = 0
    version: str = ""


class Dataset:
    """The versions under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The numbers of the versions that are there, by one listing of the folder, the last first."""
        return sorted((int(n[1:]) for n in children(self.spark, self.path) if n[:1] == "v" and n[1:].isdigit()), reverse=True)

    def latest(self) -> int:
        """The last whole version; 0 if there is none."""
        return next((v for v in self.versions() if exists(self.spark, f"{self.path}/v{v}/meta/_SUCCESS")), 0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/v{version}/{table}")

    def write(self, tables: dict[str, DataFrame], keep: int = 3) -> int:
        """Write the next version; of the older ones ``keep`` stay, for readers that are at them."""
        version = self.latest() + 1
        for name in TABLES:  # meta last
            self.put(name, tables[name], version)
        return self.prune(version, keep)

    def put(self, table: str, rows: DataFrame, version: int) -> DataFrame:
        """Write a table of a version that has no meta yet, and read it back."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}/{table}")
        return self.read(table, version)

    def drop(self, version: int) -> None:
        """Delete a version that has no meta yet."""
        remove(self.spark, f"{self.path}/v{version}")

    def prune(self, version: int, keep: int = 3) -> int:
        """Delete all but ``keep`` of the versions older than ``version``, which is returned."""
        for old in self.versions():
            if old < version - keep:
                remove(self.spark, f"{self.path}/v{old}")
        return version


def candidates(filings: DataFrame, processed: DataFrame, cutoff, limit: int | None = None) -> DataFrame:
    """Filings in the window that aren't processed, each once, as it was listed last; at most ``limit`` of each chamber in listing order, if given."""
    found = new_rows(expire(filings, cutoff), processed, FILING_KEYS)
    listed = F.col("listed") if "listed" in filings.columns else F.lit(0)
    found = found.groupBy(FILING_KEYS).agg(F.max_by(F.struct(*(F.col(c) for c in filings.columns)), F.struct(listed, "filing_date")).alias("_f")).select("_f.*")
    if limit is None:
        return found
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("chamber").orderBy("listed", "filing_id"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def planned(dataset: Dataset, filings: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    """(chamber, filing_id, member, filing_date) of the filings that run() would fetch; nothing is parsed or written."""
    cutoff = prune_cutoff(F.lit(as_of).cast("date"))
    recent = filings.filter(F.col("filing_date") >= cutoff)
    return candidates(recent, dataset.read("processed"), "0001-01-01", limit).select("chamber", "filing_id", "member", "filing_date")


def processed_by_chamber(processed: DataFrame) -> DataFrame:
    """How many processed filings each chamber has."""
    return processed.groupBy("chamber").agg(F.count("*").alias("n"))


def run(dataset: Dataset, filings: DataFrame, parse: Callable[[DataFrame], DataFrame], members: DataFrame, as_of: str, generated_at: str, featured: list[str] = (), limit: int | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None) -> RunResult:
    """Bring the dataset up to date with ``filings`` and write a version if its content has changed.

    ``filings``: chamber, filing_id, member, state, district, filing_date, source_url, is_paper,
    and what ``parse`` reads; ``parse`` gives the trades of non-paper filings, with a column
    ``error`` that is null or tells why a filing has none. ``fetch`` may bring the texts and pages
    of the filings that are read (web.fetched_filings()), and tell more of them to be paper. Paper filings are skipped for good;
    failed ones are skipped and tried again in the next run. All stored rows are enriched anew,
    and rows, skips and processed filings before the year before ``as_of`` go. The tables are written
    where the next version has them, once; if nothing has changed they are deleted.
    """
    spark, began = dataset.spark, mark()
    cutoff = spark.range(1).select(prune_cutoff(F.lit(as_of).cast("date")).alias("d")).first().d
    version = dataset.latest()
    old = {name: dataset.read(name, version) for name in TABLES}
    new = saved(candidates(filings, old["processed"], cutoff, limit), "candidates")
    if fetch is not None:
        new = saved(fetch(new), "fetched")
    parsed = saved(parse(new.filter("NOT is_paper")), "parsed")
    failed = parsed.filter("error IS NOT NULL").select(*FILING_KEYS).distinct()
    good = parsed.filter("error IS NULL").select(*TRADE_COLUMNS)
    skip = lambda rows, reason: rows.select("chamber", "member", "filing_date", F.lit(reason).alias("reason"), "filing_id", "source_url")
    skips = skip(new.filter("is_paper"), "paper").union(skip(new.join(failed, FILING_KEYS), "parse_error"))
    read = new.filter("NOT is_paper").join(failed, FILING_KEYS, "left_anti")
    done = read.unionByName(new.filter("is_paper")).select("chamber", "filing_id", "filing_date")

    merged = saved(upsert(old["trades"], good, ["id"]), "merged")
    trades = dataset.put("trades", expire(enrich(merged, members), cutoff), version + 1)
    kept = upsert(old["skipped_filings"].join(read.select("filing_id"), "filing_id", "left_anti").select(old["skipped_filings"].columns), skips, ["filing_id"])
    named = roster_lookup(kept, members).withColumn("member", F.coalesce("found.name", "member")).drop("found")
    skipped = dataset.put("skipped_filings", expire(named, cutoff), version + 1)
    processed = dataset.put("processed", expire(upsert(old["processed"], done, FILING_KEYS), cutoff), version + 1)
    result = RunResult(
        changed=changed(old["trades"], trades) or changed(old["skipped_filings"], skipped),
        fetched=new.count(),
        new_trades=good.count(),
        paper_skips=new.filter("is_paper").count(),
        parse_errors=failed.count(),
        recovered_errors=old["skipped_filings"].join(read.select("filing_id").distinct(), "filing_id", "left_semi").count(),
        pruned_trades=merged.count() - trades.count(),
    )
    if result.changed:
        meta = build_meta(trades, skipped, processed, old["meta"], members, as_of, cutoff, generated_at, featured)
        result.version = dataset.put("meta", meta, version + 1).first().data_version
        dataset.prune(version + 1)
    else:
        dataset.drop(version + 1)
    release(spark, began)
    return result


def build_meta(trades, skipped, processed, old_meta, members, as_of, cutoff, generated_at, featured) -> DataFrame:
    """One row: when, a version that counts up within a day, the window, counts, and the featured names as the roster has them."""
    spark = trades.sparkSession
    before = old_meta.select("data_version").first()
    day, _, serial = (before.data_version if before else "").rpartition(".")
    number = int(serial) + 1 if day == as_of else 1
    names = spark.createDataFrame(list(enumerate(featured)), "pos int, member string")
    found = roster_lookup(names, members, chamber=None).select("pos", F.coalesce("found.name", "member").alias("name"))
    listed = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("featured"))
    counts = trades.agg(F.count("*").alias("trades"), F.count_distinct("member").alias("members"))
    counts = counts.crossJoin(processed.agg(F.count("*").alias("filings_processed"))).crossJoin(skipped.agg(F.count("*").alias("filings_skipped")))
    window = F.struct(F.lit(cutoff).alias("from"), F.lit(as_of).cast("date").alias("to"))
    return counts.crossJoin(listed).select(
        F.lit(generated_at).alias("generated_at"),
        F.lit(f"{as_of}.{number}").alias("data_version"),
        window.alias("window"),
        F.struct("trades", "members", "filings_processed", "filings_skipped").alias("counts"),
        "featured",
        F.lit(False).alias("_sample"),
    )


def run_stream(dataset: Dataset, source: DataFrame, parse, members: DataFrame, as_of: str, generated_at: str, checkpoint: str, featured: list[str] = (), fetch: Callable[[DataFrame], DataFrame] | None = None):
    """Feed a stream of filings through run(), all that is there by now, and return the finished query.

    The filings that failed are stored after each batch, under its number, and tried again with
    the next; so a batch reads itself and those, however long the stream has gone on. A batch that
    is repeated after a failure finds what the one before it left.
    """
    waiting = f"{dataset.path}/waiting"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = sorted(int(n) for n in children(spark, waiting) if n.isdigit() and int(n) < number)
        both = batch.withColumn("_batch", F.lit(1))
        if earlier:
            both = both.unionByName(spark.read.schema(batch.schema).parquet(f"{waiting}/{earlier[-1]}").withColumn("_batch", F.lit(0)))
        last = both.groupBy(FILING_KEYS).agg(F.max_by(F.struct(*batch.columns), "_batch").alias("f")).select("f.*")
        run(dataset, last, parse, members, as_of, generated_at, featured, fetch=fetch)
        failed = dataset.read("skipped_filings").filter("reason = 'parse_error'").select(FILING_KEYS)
        last.join(failed, FILING_KEYS, "left_semi").select(batch.columns).write.mode("overwrite").parquet(f"{waiting}/{number}")
        for old in earlier[:-1]:
            remove(spark, f"{waiting}/{old}")

    query = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of a stream of events (ts, event_type) by time window; those later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
