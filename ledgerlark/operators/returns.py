"""Returns of buys since their day, from daily closes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import blank_to_null, exact_round
from ledgerlark.operators.joins import asof_join, latest_values


def buy_returns(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """(id, ticker, entry_date, entry_close, latest_close, pct) of each priced buy.

    ``prices``: ticker, day, close, as they come. The entry is the last close on or before the
    trade; buys before the first close, of unknown tickers, and entries of 0 or less have no
    return. ``pct`` comes of the closes as they are; then it is rounded to 1 digit, the closes to 4.
    """
    buys = trades.filter((F.col("type") == "buy") & blank_to_null("ticker").isNotNull()).select("id", "ticker", "tx_date")
    entered = asof_join(buys, prices, "ticker", "tx_date", "day", "close", "entry_date", "entry_close")
    latest = latest_values(prices, "ticker", "day", "close").withColumnRenamed("asof_value", "latest_close")
    priced = entered.join(latest, "ticker").filter("entry_close > 0")
    pct = (F.col("latest_close") - F.col("entry_close")) / F.col("entry_close") * 100
    closes = {c: exact_round(c, 4).alias(c) for c in ("entry_close", "latest_close")}
    return priced.select("id", "ticker", "entry_date", *closes.values(), "asof_date", exact_round(pct, 1).alias("pct"))


def ticker_prices(returns: DataFrame) -> DataFrame:
    """(ticker, asof_date, asof_close): the last close of each ticker with a priced buy."""
    return returns.groupBy("ticker").agg(F.max("asof_date").alias("asof_date"), F.max_by("latest_close", "asof_date").alias("asof_close"))


def coverage(trades: DataFrame, returns: DataFrame) -> DataFrame:
    """One row: buys with a ticker (rows), priced buys (distinct ids) and tickers priced."""
    buys = trades.filter((F.col("type") == "buy") & blank_to_null("ticker").isNotNull()).agg(F.count("*").alias("total_buys"))
    priced = returns.agg(F.count_distinct("id").alias("priced_buys"), F.count_distinct("ticker").alias("tickers"))
    return buys.crossJoin(priced)


def buy_tickers(trades: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct tickers of buys in order; the first ``limit`` of them, if given."""
    found = trades.filter((F.col("type") == "buy") & blank_to_null("ticker").isNotNull()).select("ticker").distinct().orderBy("ticker")
    return found if limit is None else found.limit(limit)
