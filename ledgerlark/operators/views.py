"""Views over a trade table: filters, orders, pages and the aggregates by ticker and member."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import blank_to_null, notional_mid
from ledgerlark.operators.ranks import ranked
from ledgerlark.operators.scratch import numbered

PAGE = 200
#: The columns of a table of trades by key: heading, whether it is a number or day, and whether one can sort by it (``pct`` stands for the return since the buy).
COLUMNS = {
    "member": ("Member", False, True),
    "ticker": ("Ticker", False, True),
    "asset": ("Asset", False, True),
    "type": ("Type", False, True),
    "amount_lo": ("Amount", True, True),
    "pct": ("Since buy", True, True),
    "tx_date": ("Traded", True, True),
    "filing_date": ("Filed", True, True),
    "source_url": ("Filing", False, False),
}
#: Columns whose first click sorts upwards; asset types whose returns aren't shown.
ASCENDING_FIRST = ("member", "ticker")
NO_RETURN_TYPES = ("Option", "Cryptocurrency")


@dataclass(frozen=True)
class TradeQuery:
    """What a page of trades is asked for by; empty values don't filter."""

    text: str = ""
    chamber: str = ""
    party: str = ""
    type: str = ""
    member: str = ""
    ticker: str = ""
    since: str = ""
    days: int = 0
    as_of: str = ""
    sort: str = "filing_date"
    descending: bool | None = None
    pages: int = 1

    def sorted_by(self, column: str) -> TradeQuery:
        """The query after a click on a heading: the same column turns round, another one starts in its own direction; one that can't be sorted by changes nothing."""
        if not COLUMNS.get(column, ("", False, False))[2]:
            return self
        return replace(self, sort=column, descending=not self.downwards if column == self.sort else None)

    @property
    def downwards(self) -> bool:
        return self.descending if self.descending is not None else self.sort not in ASCENDING_FIRST


def days_ago(as_of, days: int) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), days)


def matching(trades: DataFrame, q: TradeQuery) -> DataFrame:
    """Trades that meet every given condition; the text is looked for in member and ticker, in any case."""
    conditions = [F.col(c) == v for c, v in (("member", q.member), ("ticker", q.ticker), ("chamber", q.chamber), ("party", q.party), ("type", q.type)) if v]
    if q.text:
        needle = F.lit(q.text.lower())
        conditions.append(F.contains(F.lower("member"), needle) | F.contains(F.lower(F.coalesce("ticker", F.lit(""))), needle))
    if q.since:
        conditions.append(F.col("tx_date") >= F.lit(q.since).cast("date"))
    if q.days:
        conditions.append(F.col("tx_date") >= days_ago(q.as_of, q.days))
    return trades.filter(reduce(and_, conditions)) if conditions else trades


def page(trades: DataFrame, q: TradeQuery) -> DataFrame:
    """The matching trades in order, up to ``pages`` pages: nulls count as the least value, ties go by id upwards."""
    key = F.desc_nulls_last(q.sort) if q.downwards else F.asc_nulls_first(q.sort)
    return matching(trades, q).orderBy(key, F.asc("id")).limit(PAGE * q.pages)


def canonical_order(trades: DataFrame) -> DataFrame:
    """Trades by filing date downwards, member, trade date downwards and id."""
    return trades.orderBy(F.desc("filing_date"), "member", F.desc("tx_date"), "id")


def with_positions(trades: DataFrame, order: list[Column], name: str = "order_pos") -> DataFrame:
    """Each row's place in a total order, from 0: ranges are sorted side by side, then counted up."""
    return numbered(trades.repartitionByRange(*order).sortWithinPartitions(*order), name)


def return_of(trades: DataFrame, returns: DataFrame) -> DataFrame:
    """Trades with ``pct`` from ``returns`` (id, pct), null for other than buys and for types without one."""
    joined = trades.join(returns.select("id", "pct"), "id", "left")
    shown = (F.col("type") == "buy") & ~F.coalesce(F.col("asset_type").isin(*NO_RETURN_TYPES), F.lit(False))
    return joined.withColumn("pct", F.when(shown, F.col("pct")))


def ticker_trades(trades: DataFrame, ticker: str, since: str = "") -> DataFrame:
    """The trades of one ticker, since a day if given, the latest first; of one day in the order of their ids."""
    return matching(trades, TradeQuery(ticker=ticker, since=since)).orderBy(F.desc("tx_date"), "id")


def display(trades: DataFrame, returns: DataFrame, prices: DataFrame) -> DataFrame:
    """(id, type_text, member_text, member_chip, return_text, return_tip): what a table shows of each trade.

    ``returns``: id, entry_date, entry_close, pct. ``prices``: ticker, asof_date, asof_close. The
    chip is the party and the district, or else the state; trades whose return isn't shown have a dash and no tip.
    """
    shown = return_of(trades, returns).join(returns.select("id", "entry_date", "entry_close"), "id", "left").join(prices, "ticker", "left")
    sale = (F.col("type") == "sell") & F.coalesce("partial", F.lit(False))
    chip = F.concat_ws(" · ", blank_to_null("party"), F.coalesce(blank_to_null("district"), blank_to_null("state")))
    up = F.col("pct") >= 0
    text = F.concat(F.when(up, "+").otherwise(""), F.format_number("pct", 1), F.lit("%"))
    at = F.when(F.col("asof_close").isNotNull(), F.concat(F.lit(", now $"), F.col("asof_close").cast("string"), F.lit(" on "), F.col("asof_date").cast("string"))).otherwise("")
    tip = F.concat(F.when(up, "up").otherwise("down"), F.lit(" since $"), F.col("entry_close").cast("string"), F.lit(" on "), F.col("entry_date").cast("string"), at)
    return shown.select("id", F.when(sale, "sell (partial)").otherwise(F.col("type")).alias("type_text"), F.col("member").alias("member_text"), chip.alias("member_chip"), F.coalesce(text, F.lit("—")).alias("return_text"), F.when(F.col("pct").isNotNull(), tip).alias("return_tip"))


def modal_asset(trades: DataFrame, by: str, position: str = "order_pos") -> DataFrame:
    """Each key's most frequent asset name; of equally frequent ones the one seen first."""
    counts = trades.groupBy(by, "asset").agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(by).agg(F.max_by("asset", F.struct("n", -F.col("first"))).alias("asset"), F.max("n").alias("n"))


def top_tickers(trades: DataFrame, as_of: str, days: int = 90, limit: int = 10) -> DataFrame:
    """The most traded tickers of the last days with buys, sells, their total and its share of the largest; exchanges alone don't count."""
    recent = trades.filter((F.col("tx_date") >= days_ago(as_of, days)) & F.col("ticker").isNotNull())
    split = recent.groupBy("ticker").agg(F.count_if(F.col("type") == "buy").alias("buys"), F.count_if(F.col("type") == "sell").alias("sells"))
    split = split.withColumn("total", F.col("buys") + F.col("sells")).filter("total > 0")
    top = split.orderBy(F.desc("total"), "ticker").limit(limit)
    return top.crossJoin(F.broadcast(top.agg(F.max("total").alias("most")))).withColumn("bar", F.col("total") / F.col("most")).drop("most")


def ticker_stats(trades: DataFrame) -> DataFrame:
    """By ticker: trades, buys, sells, exchanges, members, and the notional middle of buys and of sells."""
    is_ = lambda t: F.col("type") == t
    mid = notional_mid()
    return trades.groupBy("ticker").agg(
        F.count("*").alias("n"),
        *(F.count_if(is_(t)).alias(a) for t, a in (("buy", "buys"), ("sell", "sells"), ("exchange", "exchanges"))),
        F.count_distinct("member").alias("members"),
        *(F.coalesce(F.sum(F.when(is_(t), mid)), F.lit(0.0)).alias(a) for t, a in (("buy", "buy_est"), ("sell", "sell_est"))),
    )


def member_split(trades: DataFrame, position: str = "order_pos") -> DataFrame:
    """By member: buys, sells, exchanges, their total and notional, the largest first, then the one seen first."""
    split = trades.groupBy("member").agg(
        *(F.count_if(F.col("type") == t).alias(a) for t, a in (("buy", "buys"), ("sell", "sells"), ("exchange", "exchanges"))),
        F.count("*").alias("total"),
        F.sum(notional_mid()).alias("est"),
        F.min(position).alias("first"),
    )
    return split.orderBy(F.desc("total"), "first")


def median_return(returns: DataFrame, by: str) -> DataFrame:
    """The exact median of ``pct`` for each key, and how many it has; null and 0 for a key without one.

    The one or two rows in the middle are picked by their rank, so a key with most of the rows is
    no more work for a task than others.
    """
    found = ranked(returns.select(by, "pct").filter("pct IS NOT NULL"), by, "pct")
    middle = found.filter((F.col("rank") == F.floor((F.col("n") - 1) / 2)) | (F.col("rank") == F.floor(F.col("n") / 2)))
    medians = middle.groupBy(F.col(by).alias("_by")).agg(F.avg("pct").alias("median_pct"), F.first("n").alias("n"))
    keys = returns.select(by).distinct()
    return keys.join(medians, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "median_pct", F.coalesce("n", F.lit(0)).alias("n"))


def featured_cards(trades: DataFrame, skipped: DataFrame, featured: DataFrame, as_of: str, days: int = 90, position: str = "order_pos") -> DataFrame:
    """For each featured member: recent trades, buys and sells, the latest trade by position, and paper filings."""
    recent = F.col("tx_date") >= days_ago(as_of, days)
    cards = trades.groupBy("member").agg(
        F.count_if(recent).alias("n"),
        F.count_if(recent & (F.col("type") == "buy")).alias("buys"),
        F.count_if(recent & (F.col("type") == "sell")).alias("sells"),
        F.min_by(F.struct("ticker", "asset", "tx_date"), position).alias("latest"),
    )
    paper = skipped.filter("reason = 'paper'").groupBy("member").agg(F.count("*").alias("paper"))
    out = featured.join(cards, "member", "left").join(paper, "member", "left")
    return out.fillna(0, ["n", "buys", "sells", "paper"])
