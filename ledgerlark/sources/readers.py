"""Readers of the inputs: datasets, rosters, indexes, pages, documents, prices and match configurations.

Nothing here opens a network connection; what a crawler has stored is read from any store that
Spark reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions import scalars as s
from ledgerlark.operators.upserts import merge_rosters

TRADE_SCHEMA = (
    "id string, chamber string, member string, party string, state string, district string, ticker string, asset string, asset_type string, "
    "type string, partial boolean, owner string, tx_date date, filing_date date, amount_lo long, amount_hi long, amount_label string, filing_id string, source_url string"
)
SKIP_SCHEMA = "chamber string, member string, filing_date date, reason string, filing_id string, source_url string"
META_SCHEMA = "generated_at string, data_version string, `window` struct<`from`:date,`to`:date>, counts struct<trades:long,members:long,filings_processed:long,filings_skipped:long>, featured array<string>, _sample boolean"
PROCESSED_SCHEMA = "chamber string, filing_id string, filing_date date"
INDEX_COLUMNS = ("Prefix", "Last", "First", "Suffix", "FilingType", "StateDst", "Year", "FilingDate", "DocID")
MEMBER_SCHEMA = "struct<name:string,chamber:string,party:string,state:string,district:string,aliases:array<string>>"
TEAM = "struct<name:string,attack:double,defense:double,context:double>"
CORNERS = "struct<home_corners:double,away_corners:double>"
CARDS = "struct<referee_yellow_avg:double,wc_discount:double,mismatch_bump:double>"
MATCH_SCHEMA = (
    "meta struct<home:string,away:string,venue:string,date:string,stage:string,stakes:string>, "
    f"calibration struct<base_home:double,base_away:double,rho:double,home:{TEAM},away:{TEAM}>, "
    "market struct<odds:array<double>,supercomputer:array<double>>, lambdas_override struct<home:double,away:double>, data_unstable boolean, "
    f"corners {CORNERS}, cards {CARDS}"
)
LEGISLATORS = "name struct<first:string,middle:string,last:string,official_full:string,nickname:string>, terms array<struct<type:string,state:string,district:int,party:string>>"
#: Parties by their names.
PARTIES = {"Democrat": "D", "Republican": "R", "Independent": "I"}
#: Fewest characters, blanks apart, of a document with a text layer.
MIN_TEXT = 50


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in the folder ``path``; none if it isn't there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(found)] if files.exists(found) else []


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def read_json_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """trades, skipped_filings and meta of a published JSON document; empty if it is missing or a sample.

    One document is one row, read by one task, as its format has it; read_json_lines() reads what grows.
    """
    schema = f"meta struct<{META_SCHEMA.replace(' string', ':string').replace(' date', ':date').replace(' struct', ':struct').replace(' array', ':array').replace(' boolean', ':boolean')}>, trades array<struct<{_fields(TRADE_SCHEMA)}>>, skipped_filings array<struct<{_fields(SKIP_SCHEMA)}>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], T._parse_datatype_string(schema))
    real = whole.filter(~F.coalesce("meta._sample", F.lit(False)))
    return {name: real.select(F.inline(name)) for name in ("trades", "skipped_filings")} | {"meta": real.select("meta.*")}


def read_returns(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """returns (id, entry_date, entry_close, pct) and prices (ticker, asof_date, asof_close) of a published returns document; both empty if it is missing, as it may be."""
    shape = "returns map<string,struct<entry_date:date,entry_close:double,pct:double>>, prices map<string,struct<asof_date:date,asof_close:double>>"
    whole = spark.read.schema(shape).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], T._parse_datatype_string(shape))
    return {name: whole.select(F.explode(name).alias(key, "v")).select(key, "v.*") for name, key in (("returns", "id"), ("prices", "ticker"))}


def read_returns_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What read_returns() gives, of a document as sinks.publish_returns_document() writes it: its lines are read side by side."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r'^  ("(?:[^"\\]|\\.)*"): (\{.*\}),?$', 1).alias("key"), F.regexp_extract("value", r'^  "(?:[^"\\]|\\.)*": (\{.*\}),?$', 1).alias("body")).filter("key <> ''")
    key = F.from_json(F.concat(F.lit('{"k":'), "key", F.lit("}")), "k string")["k"]
    found = lines.select(key.alias("key"), F.from_json("body", "entry_date date, entry_close double, pct double, asof_date date, asof_close double").alias("v")).select("key", "v.*")
    gains = found.filter("entry_date IS NOT NULL").select(F.col("key").alias("id"), "entry_date", "entry_close", "pct")
    return {"returns": gains, "prices": found.filter("asof_date IS NOT NULL").select(F.col("key").alias("ticker"), "asof_date", "asof_close")}


def read_yearly_indexes(spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    """The indexes ``<year>FD.txt`` under ``folder`` of the years from the retention cutoff to ``as_of``, one after the other; years without one are left out."""
    paths = [f"{folder}/{year}FD.txt" for year in range(int(as_of[:4]) - 1, int(as_of[:4]) + 1)]
    found = [read_index(spark, p) for p in paths if exists(spark, p)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], ", ".join(f"{c} string" for c in INDEX_COLUMNS))


def read_json_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """trades and skipped_filings of line files under ``path`` (sinks.publish_lines()): the form for datasets too large for one document, read side by side."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in (("trades", TRADE_SCHEMA), ("skipped_filings", SKIP_SCHEMA))}


def _fields(ddl: str) -> str:
    return ",".join(":".join(column.split(" ", 1)) for column in ddl.split(", "))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Members of a roster document with their position; entries that aren't objects are left out."""
    members = spark.read.schema("members array<string>").option("multiLine", True).json(path)
    entries = members.select(F.posexplode("members").alias("position", "entry")).filter(F.col("entry").startswith("{"))
    return entries.withColumn("m", F.from_json("entry", MEMBER_SCHEMA)).filter("m.name IS NOT NULL").select("m.*", "position")


def read_featured(spark: SparkSession, path: str) -> DataFrame:
    """(position, name) of a JSON array of names."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "name"))


def build_roster(legislators: DataFrame) -> DataFrame:
    """A roster from legislators' records (name{first,middle,last,official_full,nickname}, terms[{type,state,district,party}]): by the last term, with an alias for each way in which the names may be put together."""
    term, n = F.element_at("terms", -1), F.col("name")
    first, last = (F.coalesce(n[c], F.lit("")) for c in ("first", "last"))
    middle, nickname = s.blank_to_null(n["middle"]), s.blank_to_null(n["nickname"])
    name = F.coalesce(n["official_full"], F.concat(first, F.lit(" "), last))
    senate = term["type"] == "sen"
    chamber = F.when(senate, "senate").otherwise("house")
    party = F.coalesce(F.try_element_at(s.literal_map(PARTIES), term["party"]), term["party"])
    spaced = lambda *parts: F.concat(*(x for p in parts for x in (p, F.lit(" "))), last)
    before = lambda given: F.concat(last, F.lit(", "), given)
    aliases = F.array(before(first), spaced(first), spaced(first, middle), spaced(middle), spaced(nickname), before(nickname), spaced(nickname, middle))
    district = F.when(~senate, F.concat(term["state"], F.lit("-"), term["district"].cast("string")))
    return legislators.select(name.alias("name"), chamber.alias("chamber"), party.alias("party"), term["state"].alias("state"), district.alias("district"), F.array_sort(F.array_remove(F.array_distinct(F.array_compact(aliases)), name)).alias("aliases"))


def merged_roster(spark: SparkSession, legislators: DataFrame, old: str) -> DataFrame:
    """build_roster() with the aliases of the roster document at ``old``, and its members that are no longer among the records."""
    return merge_rosters(read_roster(spark, old).drop("position"), build_roster(legislators))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated index with a header; short rows have nulls, and a header that lacks columns is an error."""
    index = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)
    lacking = set(INDEX_COLUMNS) - {c.lstrip("﻿") for c in index.columns}
    if lacking:
        raise ValueError(f"index without columns {sorted(lacking)}")
    return index.toDF(*(c.lstrip("﻿") for c in index.columns))


def index_rows(content: bytes) -> list[list[str | None]]:
    """The rows, as INDEX_COLUMNS, of the first .txt member of an archive; bytes that aren't UTF-8 are replaced, and an index without one of the columns is an error."""
    import csv
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        name = next(n for n in archive.namelist() if n.lower().endswith(".txt"))
        text = archive.read(name).decode("utf-8-sig", "replace")
    found = list(csv.reader(io.StringIO(text), delimiter="\t", quoting=csv.QUOTE_NONE))
    lacking = set(INDEX_COLUMNS) - set(found[0] if found else ())
    if lacking:
        raise ValueError(f"index without columns {sorted(lacking)}")
    at = [found[0].index(c) for c in INDEX_COLUMNS]
    return [[row[k] if k < len(row) else None for k in at] for row in found[1:] if any(row)]


def read_zipped_index(spark: SparkSession, path: str) -> DataFrame:
    """The indexes in the archives at ``path`` (index_rows())."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                columns = list(zip(*index_rows(content.as_py()), strict=True)) or [()] * len(INDEX_COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=list(INDEX_COLUMNS))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{c} string" for c in INDEX_COLUMNS))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content) of stored filings; the kind is the suffix, and one that isn't html, txt or pdf is an error."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.when(kind.isin("html", "txt", "pdf"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of filing: "), F.col("path"))))
    return files.select("path", known.alias("kind"), "content")


def layered_text(text) -> F.Column:
    """The text, or an empty one where it has too few characters not to be a scan."""
    return F.when(F.length(s.strip(text)) < MIN_TEXT, F.lit("")).otherwise(s.as_column(text))


def read_prices(payloads: DataFrame) -> DataFrame:
    """(ticker, day, close) of chart answers (ticker, body): adjusted closes where the answer has them, else closes, as they are; the last of a day; nothing of a malformed one."""
    shape = "chart struct<result:array<struct<timestamp:array<long>,indicators:struct<quote:array<struct<close:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>,error:string>"
    result = F.try_element_at(F.from_json("body", shape)["chart"]["result"], F.lit(1))
    closes = F.coalesce(F.try_element_at(result["indicators"]["adjclose"], F.lit(1))["adjclose"], F.try_element_at(result["indicators"]["quote"], F.lit(1))["close"])
    pairs = payloads.select("ticker", F.posexplode(F.arrays_zip(result["timestamp"].alias("ts"), closes.alias("close"))).alias("pos", "x"))
    known = pairs.filter("x.ts IS NOT NULL AND x.close IS NOT NULL").select("ticker", F.timestamp_seconds("x.ts").cast("date").alias("day"), "pos", F.col("x.close").alias("close"))
    return known.groupBy("ticker", "day").agg(F.max_by("close", "pos").alias("close"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Match configurations, one document each, as columns for probability.predict(); notes (keys with a leading underscore) are left out."""
    raw = spark.read.schema(MATCH_SCHEMA).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    return match_columns(raw, F.regexp_extract("path", r"([^/]+)\.json$", 1))


def match_columns(raw: DataFrame, key: F.Column) -> DataFrame:
    """Match documents, parsed by MATCH_SCHEMA, as columns for probability.predict(), missing names and texts by default."""
    c, odds = F.col("calibration"), F.col("market.odds")
    return raw.select(
        key.alias("match_id"),
        F.coalesce("meta.home", "calibration.home.name", F.lit("Home")).alias("home"),
        F.coalesce("meta.away", "calibration.away.name", F.lit("Away")).alias("away"),
        *(F.coalesce(f"meta.{k}", F.lit("")).alias(k) for k in ("venue", "date", "stage", "stakes")),
        *(c[k].alias(k) for k in ("base_home", "base_away", "rho")),
        *(c[side][k].alias(f"{side}_{k}") for side in ("home", "away") for k in ("attack", "defense", "context")),
        F.col("lambdas_override.home").alias("override_home"),
        F.col("lambdas_override.away").alias("override_away"),
        *(F.try_element_at(odds, F.lit(k + 1)).alias(f"odds_{name}") for k, name in enumerate(("home", "draw", "away"))),
        "data_unstable", "corners", "cards", F.col("market.supercomputer").alias("supercomputer"),
    )
