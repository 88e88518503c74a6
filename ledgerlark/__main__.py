"""Entry points for spark-submit: predictions, filings, rosters and returns."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import scalars
from ledgerlark.operators import contracts, filings, probability, returns, schemas
from ledgerlark.sources import html_tables, pdf, readers, sinks, web
from ledgerlark.streaming import incremental

CHAMBERS = ("house", "senate")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerlark")
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name, text: commands.add_parser(name, help=text)

    def shown(command):
        command.add_argument("--json", action="store_true", help="JSON in place of the text report")
        command.add_argument("--knockout", action="store_true", help="with who advances")
        command.add_argument("--samples", type=int, default=0, help="draws to hold against the exact probabilities")
        return command

    predict = shown(add("predict", "predict all match configurations of a folder"))
    predict.add_argument("configs")
    predict.add_argument("--out", help="write Parquet there")
    quick = shown(add("quick", "predict one match from its mean scores"))
    quick.add_argument("lam_home", type=float)
    quick.add_argument("lam_away", type=float)
    quick.add_argument("--home", default="Home")
    quick.add_argument("--away", default="Away")
    quick.add_argument("--rho", type=float, default=probability.DEFAULTS["rho"])
    quick.add_argument("--odds", type=float, nargs=3, metavar=("HOME", "DRAW", "AWAY"))
    priced = add("returns", "returns of a dataset's buys from stored chart answers (Parquet: ticker, body)")
    for name in ("dataset", "charts", "out"):
        priced.add_argument(name)
    priced.add_argument("--limit", type=int, help="at most so many tickers")
    for name in ("ingest", *CHAMBERS):
        fetch = add(name, f"bring a dataset up to date with stored filings (Parquet){'' if name == 'ingest' else f' of the {name}'}")
        for given in ("dataset", "filings", "roster", "as_of"):
            fetch.add_argument(given)
        fetch.add_argument("--limit", type=int)
        fetch.add_argument("--dry-run", action="store_true", help="list what would be fetched, write nothing")
        fetch.add_argument("--document", help="write the published document there")
    live = add("fetch", "bring a dataset up to date from the chambers' sites")
    for given in ("dataset", "sites", "roster", "as_of"):
        live.add_argument(given, help="JSON: senate {home, search, base}, house {index with {year}, base}, and manners" if given == "sites" else None)
    live.add_argument("--chamber", choices=("both", *CHAMBERS), default="both")
    live.add_argument("--limit", type=int)
    live.add_argument("--dry-run", action="store_true", help="list what would be fetched, write nothing")
    live.add_argument("--document", help="write the published document there")
    priced = add("charts", "download the chart answers of a dataset's buys as Parquet (ticker, body)")
    for given in ("dataset", "sites", "out"):
        priced.add_argument(given, help="JSON: prices {chart with {symbol}, cookie, crumb}, and manners" if given == "sites" else None)
    priced.add_argument("--limit", type=int, help="at most so many tickers")
    check = add("check", "hold an endpoint's answer against a schema")
    for given in ("environments", "schemas", "schema", "path"):
        check.add_argument(given, help="JSON: base addresses by environment" if given == "environments" else None)
    check.add_argument("--env", help="the environment; dev by default")
    check.add_argument("--status", type=int, help="the expected status; any of 2xx by default")
    parse = add("parse-ptr", "trades of one stored filing (.html, .txt or .pdf) as JSON lines")
    parse.add_argument("file")
    parse.add_argument("--member", default="Local Filer")
    roster = add("roster", "a roster document from legislators' records (JSON) and an older roster")
    for name in ("legislators", "old", "out"):
        roster.add_argument(name)
    return top


def parse_filings(rows: DataFrame) -> DataFrame:
    """Trades or errors of filings of both chambers: pages (``html``) of the senate, texts (``text``) of the house."""
    senate = rows.filter("chamber = 'senate'")
    pages = html_tables.html_rows(senate, "filing_id") if "html" in rows.columns else None
    house = filings.text_trades(rows.filter("chamber = 'house'"))
    return house.unionByName(filings.table_trades(senate, pages)) if pages is not None else house


def _show(found: DataFrame, as_json: bool) -> None:
    for row in (sinks.result_json(found) if as_json else sinks.match_report(found)).orderBy("match_id").toLocalIterator():
        print(row[1])


def _quick(spark: SparkSession, args) -> DataFrame:
    given = {"home": args.home, "away": args.away, "rho": args.rho, "override_home": args.lam_home, "override_away": args.lam_away}
    odds = args.odds or [None] * 3
    none = {c: None for side in ("home", "away") for c in (f"base_{side}", *(f"{side}_{k}" for k in ("attack", "defense", "context")))}
    columns = {c: F.lit(v).cast("double") for c, v in (none | dict(zip(("odds_home", "odds_draw", "odds_away"), odds, strict=True))).items()}
    columns |= {c: F.lit(v) for c, v in given.items()} | {c: F.lit("quick" if c == "stage" else "") for c in ("venue", "date", "stage", "stakes")}
    columns |= {"data_unstable": F.lit(False), "supercomputer": F.lit(None).cast("array<double>"), "corners": F.lit(None).cast(readers.CORNERS), "cards": F.lit(None).cast(readers.CARDS)}
    return spark.range(1).select(F.lit("quick").alias("match_id"), *(v.alias(c) for c, v in columns.items()))


def _ingest(spark: SparkSession, args) -> int:
    data, rows = incremental.Dataset(spark, args.dataset), spark.read.parquet(args.filings)
    if args.command in CHAMBERS:
        rows = rows.filter(F.col("chamber") == args.command)
    if args.dry_run:
        incremental.planned(data, rows, args.as_of, args.limit).orderBy("chamber", "filing_id").show(truncate=False)
        return 0
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    print(incremental.run(data, rows, parse_filings, readers.read_roster(spark, args.roster), args.as_of, stamp, limit=args.limit))
    if args.document:
        sinks.publish_document(data.read("trades"), data.read("skipped_filings"), data.read("meta"), args.document)
    return 0


def _sites(path: str) -> tuple[dict, dict]:
    """The sites in a JSON file, and the manners towards them."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    return given, {k: str(v) for k, v in given.items() if not isinstance(v, dict)}


def _fetch(spark: SparkSession, args) -> int:
    given, manners = _sites(args.sites)
    data = incremental.Dataset(spark, args.dataset)
    cutoff = spark.range(1).select(scalars.prune_cutoff(F.lit(args.as_of).cast("date")).alias("d")).first().d
    asked = dict(manners)
    if args.chamber in ("both", "senate"):
        asked |= {k: given["senate"][k] for k in ("home", "search") if k in given["senate"]} | {"from": f"{cutoff:%m/%d/%Y}"}
    if args.chamber in ("both", "house"):
        asked |= {"index": given["house"]["index"], "first_year": str(cutoff.year), "last_year": args.as_of[:4]}
    web.register(spark)
    rows = web.listed_filings(spark.read.format("chamber_listings").options(**asked).load(), *(given.get(c, {}).get("base", "") for c in ("senate", "house")))
    if args.dry_run:
        incremental.planned(data, rows, args.as_of, args.limit).orderBy("chamber", "filing_id").show(truncate=False)
        return 0
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    print(incremental.run(data, rows, parse_filings, readers.read_roster(spark, args.roster), args.as_of, stamp, limit=args.limit, fetch=lambda new: web.fetched_filings(new, **manners)))
    if args.document:
        sinks.publish_document(data.read("trades"), data.read("skipped_filings"), data.read("meta"), args.document)
    return 0


def _charts(spark: SparkSession, args) -> int:
    given, manners = _sites(args.sites)
    tickers = returns.buy_tickers(incremental.Dataset(spark, args.dataset).read("trades"), args.limit)
    web.price_charts(tickers, **given["prices"], **manners).write.mode("overwrite").parquet(args.out)
    return 0


def _check(spark: SparkSession, args) -> int:
    """0 for an answer as expected, else 1 and what is wrong with it."""
    with open(args.environments, encoding="utf-8") as file:
        base = contracts.environment(json.load(file), args.env)
    web.register(spark)
    answers = spark.read.format("polite_fetch").option("urls", base.rstrip("/") + args.path).load().withColumn("body", F.decode("body", "UTF-8"))
    found = schemas.checked_answers(answers, schemas.named(spark, args.schemas, args.schema), args.status).select("status", "error", "ok", schemas.detail("breaches").alias("detail")).first()
    if not found.ok:
        print(f"{args.path}: status {found.status}{f' ({found.error})' if found.error else ''}\n{found.detail}", file=sys.stderr)
    return 0 if found.ok else 1


def _parse_ptr(spark: SparkSession, args) -> int:
    """0; 1 for a file without a text layer, 2 for one of another kind."""
    kind = os.path.splitext(args.file)[1].lower()
    if kind not in (".html", ".txt", ".pdf"):
        print(f"no reader for {kind or args.file}", file=sys.stderr)
        return 2
    text = pdf.read_pdfs(spark, args.file).select("text") if kind == ".pdf" else spark.read.option("wholetext", True).text(args.file).select(F.col("value").alias("text"))
    if kind != ".html" and text.filter(readers.layered_text("text") != "").isEmpty():
        print("no text layer", file=sys.stderr)
        return 1
    fixed = {"filing_id": "local", "member": args.member, "source_url": args.file, "chamber": "senate" if kind == ".html" else "house"}
    none = F.lit(None).cast("string")
    rows = text.select(*(F.lit(v).alias(c) for c, v in fixed.items()), none.alias("state"), none.alias("district"), F.lit("1970-01-01").cast("date").alias("filing_date"), "text", F.col("text").alias("html"))
    for row in parse_filings(rows).orderBy("id").select(F.to_json(F.struct("*"), sinks.NULLS)).toLocalIterator():
        print(row[0])
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("predict", "quick"):
        matches = readers.read_matches(spark, args.configs) if args.command == "predict" else _quick(spark, args)
        found = probability.full_results(matches, with_knockout=args.knockout, samples=args.samples)
        if args.command == "predict" and args.out:
            found.write.mode("overwrite").parquet(args.out)
        else:
            _show(found, args.json)
    elif args.command == "returns":
        trades = incremental.Dataset(spark, args.dataset).read("trades")
        prices = readers.read_prices(spark.read.parquet(args.charts).join(returns.buy_tickers(trades, args.limit), "ticker", "left_semi"))
        return 0 if sinks.publish_returns(returns.buy_returns(trades, prices), args.out) else 1
    elif args.command in ("fetch", "charts", "check", "parse-ptr"):
        return {"fetch": _fetch, "charts": _charts, "check": _check, "parse-ptr": _parse_ptr}[args.command](spark, args)
    elif args.command == "roster":
        legislators = spark.read.schema(readers.LEGISLATORS).option("multiLine", True).json(args.legislators)
        sinks.publish_roster(readers.merged_roster(spark, legislators, args.old), args.out)
    else:
        return _ingest(spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
