"""Writers of published tables, documents, JSON lines and text reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.probability import ALIGNED, CARD_LINES, CORNER_LINES, DIVERGENCE, GOAL_LINES, REVIEW
from ledgerlark.operators.upserts import changed
from ledgerlark.operators.views import with_positions

NULLS = {"ignoreNullFields": "false"}


def publish(after: DataFrame, path: str, before: DataFrame | None = None) -> bool:
    """Write ``after`` as Parquet at ``path`` unless it has the rows of ``before``; whether it was written."""
    if before is not None and not changed(before, after):
        return False
    after.write.mode("errorifexists").parquet(path)
    return True


def publish_returns(returns: DataFrame, path: str) -> bool:
    """Write the returns, unless none was priced: then what is there stays."""
    if returns.isEmpty():
        return False
    returns.write.mode("overwrite").parquet(path)
    return True


def json_lines(rows: DataFrame, path: str, order: list) -> None:
    """One JSON object a line, in order over the part files."""
    rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def dump_payloads(payloads: DataFrame, path: str) -> None:
    """Raw payloads (name, body) for looking into: a JSON object a line, by name."""
    json_lines(payloads.select("name", "body"), path, ["name"])


def publish_lines(trades: DataFrame, skipped: DataFrame, path: str) -> None:
    """The dataset as line files, which readers.read_json_lines() reads side by side."""
    json_lines(trades, f"{path}/trades", trade_order())
    json_lines(skipped, f"{path}/skipped_filings", skip_order())


def trade_order() -> list[Column]:
    """Filing date downwards, member, trade date downwards, id."""
    return [F.desc("filing_date"), F.asc("member"), F.desc("tx_date"), F.asc("id")]


def skip_order() -> list[Column]:
    """Filing date and id, both downwards."""
    return [F.desc("filing_date"), F.desc("filing_id")]


def _array_lines(rows: DataFrame, order: list, section: int) -> DataFrame:
    """(section, pos, line) of ``rows`` as elements of a JSON array, one a line, in order."""
    placed = with_positions(rows, order, "_pos")
    comma = F.when(F.col("_pos") == F.lit(placed.count() - 1), "").otherwise(",")
    text = F.concat(F.lit("  "), F.to_json(F.struct(*rows.columns), NULLS), comma)
    return placed.select(F.lit(section).alias("section"), F.col("_pos").alias("pos"), text.alias("line"))


def document_lines(trades: DataFrame, skipped: DataFrame, meta: DataFrame) -> DataFrame:
    """(section, pos, line) of the published document: its meta in readable form, then trades and skips in canonical order, one a line. Any number of rows is sorted side by side."""
    spark = trades.sparkSession
    fixed = lambda section, text: spark.createDataFrame([(section, 0, text)], "section int, pos long, line string")
    head = meta.select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("pos"), F.concat(F.to_json(F.struct(*meta.columns), NULLS | {"pretty": "true"}), F.lit(",")).alias("line"))
    parts = [fixed(0, '{\n"meta": '), head, fixed(2, '"trades": ['), _array_lines(trades, trade_order(), 3), fixed(4, '],\n"skipped_filings": ['), _array_lines(skipped, skip_order(), 5), fixed(6, "]\n}")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def publish_document(trades: DataFrame, skipped: DataFrame, meta: DataFrame, path: str) -> None:
    """The published JSON document as text: its part files, one after the other, are the document."""
    document_lines(trades, skipped, meta).orderBy("section", "pos").select("line").write.mode("overwrite").text(path)


def publish_returns_document(returns: DataFrame, prices: DataFrame, stats: dict, path: str) -> bool:
    """The returns document: meta, then each ticker's last close and each priced buy's return by key, a line each. Not written if nothing was priced."""
    if returns.isEmpty():
        return False
    spark = returns.sparkSession
    fixed = lambda section, text: spark.createDataFrame([(section, 0, text)], "section int, pos long, line string")

    def entries(rows: DataFrame, key: str, columns: list[str], section: int) -> DataFrame:
        placed = with_positions(rows.select(key, *columns), [F.asc(key)], "_pos")
        comma = F.when(F.col("_pos") == F.lit(placed.count() - 1), "").otherwise(",")
        name = F.regexp_extract(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), r"^\{\"k\":(.*)\}$", 1)
        return placed.select(F.lit(section).alias("section"), F.col("_pos").alias("pos"), F.concat(F.lit("  "), name, F.lit(": "), F.to_json(F.struct(*columns), NULLS), comma).alias("line"))

    lines = fixed(0, f'{{\n"meta": {json.dumps(stats)},\n"prices": {{').unionByName(entries(prices, "ticker", ["asof_date", "asof_close"], 1))
    lines = lines.unionByName(fixed(2, '},\n"returns": {')).unionByName(entries(returns, "id", ["entry_date", "entry_close", "pct"], 3)).unionByName(fixed(4, "}\n}"))
    lines.orderBy("section", "pos").select("line").write.mode("overwrite").text(path)
    return True


def publish_roster(members: DataFrame, path: str) -> None:
    """A roster document, its members by name, one a line, in one file: its members are those of two chambers."""
    spark, own = members.sparkSession, members.drop("position")
    fixed = lambda section, text: spark.createDataFrame([(section, 0, text)], "section int, pos long, line string")
    lines = fixed(0, '{\n"members": [').unionByName(_array_lines(own, [F.asc("name"), F.asc("chamber")], 1)).unionByName(fixed(2, "]\n}"))
    lines.repartition(1).sortWithinPartitions("section", "pos").select("line").write.mode("overwrite").text(path)


def _pct(x) -> Column:
    return F.format_string("%.1f%%", (F.col(x) if isinstance(x, str) else x) * 100)


def _named(line: float) -> str:
    return str(line).replace(".", "_")


def match_report(full: DataFrame) -> DataFrame:
    """(match_id, report): a text of each match of probability.full_results(), in nine numbered sections, and those of corners, cards, knockout and sampling where there are such."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    either = lambda over, line: say(f"  Over {line}: ", _pct(over), "  Under: ", _pct(1 - over))

    def extra(market: str, title: str, lines) -> Column:
        own = F.try_element_at(F.filter("extras", lambda e: e["market"] == market), F.lit(1))
        rows = [either(F.get(own["overs"], k), line) for k, line in enumerate(lines)]
        return F.when(own.isNotNull(), F.concat_ws("\n", F.lit(title), say("  Mean ", F.format_string("%.2f", own["mean"])), *rows))

    sources = F.transform("validation", lambda v: say("  ", v["source"], ": ", _pct(v["home"]), " / ", _pct(v["draw"]), " / ", _pct(v["away"])))
    margin = F.when(F.col("fair").isNotNull(), say("  Margin ", _pct(F.col("fair.overround")), ", furthest apart ", F.format_string("%.1f", F.col("divergence") * 100), " pts: ", F.when(F.col("divergence") <= DIVERGENCE, ALIGNED).otherwise(REVIEW)))
    checked = F.when(F.size("validation") > 1, F.concat_ws("\n", F.array_join(sources, "\n"), margin)).otherwise("  Nothing to compare with")
    sections = [
        say(F.upper("home"), " - ", F.upper("away")),
        F.concat_ws("\n", F.lit("[1] MATCH"), *(F.when(F.col(c) != "", say(f"  {c.capitalize()}: ", F.col(c))) for c in ("venue", "date", "stage", "stakes"))),
        say("[2] CALIBRATION\n", F.col("calibration"), "\n  Expected goals ", F.format_string("%.2f - %.2f", "xg_home", "xg_away")),
        say("[3] 1X2\n  Home ", _pct("p_home"), "  Draw ", _pct("p_draw"), "  Away ", _pct("p_away")),
        say("[4] VALIDATION\n", checked),
        F.concat_ws("\n", say("[5] GOALS\n  Total ", F.format_string("%.2f", F.col("xg_home") + F.col("xg_away"))), *(either(F.col(f"over_{_named(x)}"), x) for x in GOAL_LINES), say("  Both score: ", _pct("btts")), say("  Clean sheets: ", _pct("clean_home"), " / ", _pct("clean_away"))),
        extra("corners", "[5b] CORNERS", CORNER_LINES),
        extra("cards", "[5c] CARDS", CARD_LINES),
        say("[6] SCORES\n", F.array_join(F.transform("scores", lambda s: say("  ", s["score"], ": ", _pct(s["p"]))), "\n")),
        say("[7] CONFIDENCE\n  ", F.col("confidence.level"), ": ", F.col("confidence.reason")),
        say("[8] RECOMMENDATION\n  ", F.col("recommended.result"), " (", _pct("recommended.p"), "), ", F.col("scoreline"), " (", _pct("scoreline_p"), ")"),
        say("[9] CAUTION\n  These are probabilities, not forecasts", F.when(F.col("confidence.level") == "LOW", "; this match is an even one").otherwise(""), "."),
        F.when(F.col("knockout").isNotNull(), say("[K] KNOCKOUT\n  Advance: ", _pct("knockout.adv_home"), " / ", _pct("knockout.adv_away"), "\n  Extra time ", _pct("knockout.p_draw_reg"), ", penalties ", _pct("knockout.p_pens"))),
        F.when(F.col("sampled").isNotNull(), say("[+] SAMPLING\n  Largest difference ", F.format_string("%.2f", F.col("sampled.max_difference") * 100), " pts")),
    ]
    return full.select("match_id", F.concat_ws("\n\n", *sections).alias("report"))


def result_json(full: DataFrame) -> DataFrame:
    """(match_id, result): each match of probability.full_results() as a JSON object."""
    side = lambda home, away: F.struct(F.col(home).alias("home"), F.col(away).alias("away"))
    lines = lambda kind: F.struct(*(F.col(f"{kind}_{_named(x)}").alias(str(x)) for x in GOAL_LINES))
    markets = F.struct(
        F.struct(F.col("p_home").alias("home"), F.col("p_draw").alias("draw"), F.col("p_away").alias("away")).alias("1x2"),
        lines("over").alias("over"), lines("under").alias("under"),
        F.struct(F.col("btts").alias("yes"), (1 - F.col("btts")).alias("no")).alias("btts"),
        side("clean_home", "clean_away").alias("clean_sheet"), side("xg_home", "xg_away").alias("xg"),
        (F.col("xg_home") + F.col("xg_away")).alias("expected_total_goals"),
        F.transform("scores", lambda s: F.struct(s["score"].alias("score"), s["p"].alias("prob"))).alias("top_scorelines"),
    )
    k = F.col("knockout")
    advance = F.struct(
        F.struct(k["adv_home"].alias("home"), k["adv_away"].alias("away")).alias("advance"),
        F.struct(k["win_reg"].alias("win_regulation"), k["win_et"].alias("win_extra_time"), k["win_pens"].alias("win_penalties")).alias("home_breakdown"),
        k["p_draw_reg"].alias("goes_to_extra_time"), k["p_pens"].alias("goes_to_penalties"),
    )
    best = F.struct(F.col("recommended.result").alias("result"), F.col("recommended.p").alias("result_prob"), F.col("scoreline").alias("scoreline"), F.col("scoreline_p").alias("scoreline_prob"))
    whole = F.struct(F.concat_ws(" vs ", "home", "away").alias("match"), side("xg_home", "xg_away").alias("lambdas"), markets.alias("markets"), "confidence", best.alias("recommendation"), F.col("divergence").alias("market_divergence"), F.when(k.isNotNull(), advance).alias("knockout"))
    return full.select("match_id", F.to_json(whole).alias("result"))
