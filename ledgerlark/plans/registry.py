"""Queries over the driver's tables, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import scalars
from ledgerlark.operators import contracts, filings, joins, probability, returns, upserts, views

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    """Register the function under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    SELECT p_brand AS ticker,
           count(*) FILTER (l_returnflag = 'A') AS buys,
           count(*) FILTER (l_returnflag = 'R') AS sells,
           count(*) FILTER (l_returnflag IN ('A', 'R')) AS total
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '2001-08-06'
    GROUP BY p_brand HAVING count(*) FILTER (l_returnflag IN ('A', 'R')) > 0
    ORDER BY total DESC, ticker LIMIT 10
    """
)
def top_split_tickers(spark, sf_dir):
    """The ten most traded brands of the last 90 days, with their buys and sells."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("exchange")
    rows = items.select(F.col("p_brand").alias("ticker"), kind.alias("type"), F.col("l_shipdate").alias("tx_date"))
    return views.top_tickers(rows, "2001-11-04").select("ticker", "buys", "sells", "total")


TRADES = """
    SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey AS id, c_name AS member, n_name AS ticker, c_mktsegment AS asset,
           CASE o_orderstatus WHEN 'F' THEN 'buy' WHEN 'O' THEN 'sell' ELSE 'exchange' END AS type,
           CAST(o_orderdate AS DATE) AS tx_date, CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT) + 1 AS amount_lo,
           CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT) + 1000 END AS amount_hi
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def trades(spark, sf_dir: str):
    """Orders in the shape of trades: nations as tickers, customers as members."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    status = F.col("o_orderstatus")
    floor = (F.floor(F.col("o_totalprice") / 1000) * 1000).cast("long")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("member"),
        F.col("n_name").alias("ticker"),
        F.col("c_mktsegment").alias("asset"),
        F.when(status == "F", "buy").when(status == "O", "sell").otherwise("exchange").alias("type"),
        F.col("o_orderdate").cast("date").alias("tx_date"),
        (floor + 1).alias("amount_lo"),
        F.when(~F.col("o_orderpriority").startswith("1"), floor + 1000).alias("amount_hi"),
    )


@query(
    """
    SELECT event_id AS id, user_id, event_type AS type, CAST(ts AS DATE) AS tx_date, value
    FROM events WHERE event_type = 'purchase' AND contains(lower(props), '"k": 1') AND CAST(ts AS DATE) >= DATE '2024-01-10'
    ORDER BY value DESC NULLS LAST, event_id LIMIT 200
    """
)
def optional_filter_page(spark, sf_dir):
    """One page of purchases since a day, by value downwards."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("type"), F.col("ts").cast("date").alias("tx_date"), "value", F.col("props").alias("member"), F.lit(None).cast("string").alias("ticker"))
    asked = views.TradeQuery(text='"K": 1', type="purchase", as_of="2024-01-30", days=20, sort="value")
    return views.page(rows, asked).select("id", "user_id", "type", "tx_date", "value")


@query(
    f"""
    WITH t AS ({TRADES})
    SELECT ticker, count(*) AS n, count(*) FILTER (type = 'buy') AS buys, count(*) FILTER (type = 'sell') AS sells,
           count(*) FILTER (type = 'exchange') AS exchanges, count(DISTINCT member) AS members,
           coalesce(sum(coalesce((amount_lo + amount_hi) / 2.0, amount_lo)) FILTER (type = 'buy'), 0.0) AS buy_est,
           coalesce(sum(coalesce((amount_lo + amount_hi) / 2.0, amount_lo)) FILTER (type = 'sell'), 0.0) AS sell_est
    FROM t GROUP BY ticker
    """
)
def ticker_stats(spark, sf_dir):
    return views.ticker_stats(trades(spark, sf_dir))


@query(
    f"""
    WITH t AS ({TRADES})
    SELECT member, count(*) FILTER (type = 'buy') AS buys, count(*) FILTER (type = 'sell') AS sells,
           count(*) FILTER (type = 'exchange') AS exchanges, count(*) AS total,
           sum(coalesce((amount_lo + amount_hi) / 2.0, amount_lo)) AS est, min(id) AS "first"
    FROM t GROUP BY member
    """
)
def member_pivot(spark, sf_dir):
    return views.member_split(trades(spark, sf_dir), "id")


@query(
    f"""
    WITH t AS ({TRADES}), c AS (SELECT ticker, asset, count(*) AS n, min(id) AS f FROM t GROUP BY ALL)
    SELECT ticker, asset, n FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, f) = 1
    """
)
def modal_name(spark, sf_dir):
    return views.modal_asset(trades(spark, sf_dir), "ticker", "id")


@query(
    """
    SELECT p_brand AS brand, round(median(l_extendedprice / l_quantity), 6) AS median_pct, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1
    """
)
def median_return(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = views.median_return(items.select(F.col("p_brand").alias("brand"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("pct")), "brand")
    return found.withColumn("median_pct", F.round("median_pct", 6))


@query(
    """
    WITH prices AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS c FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
         buys AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS tx_date, l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'A')
    SELECT id, line, part, tx_date, d AS entry_date, c AS entry_close FROM buys ASOF LEFT JOIN prices ON buys.part = prices.part AND buys.tx_date >= prices.d
    """.replace("SELECT id, line, part, tx_date", "SELECT id, line, buys.part AS part, tx_date")
)
def asof_entry(spark, sf_dir):
    """The last price of the same part on or before each buy."""
    items = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    prices = items.filter("l_returnflag <> 'A'").select(F.col("l_partkey").alias("part"), "day", F.col("l_extendedprice").alias("close"))
    buys = items.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("day").alias("tx_date"))
    return joins.asof_join(buys, prices, "part", "tx_date", "day", "close", "entry_date", "entry_close")


@query(
    """
    WITH prices AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
         buys AS (SELECT o_orderkey AS id, 'Brand#' || CAST(1 + o_custkey % 5 AS VARCHAR) || CAST(1 + o_orderkey % 5 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS tx_date FROM orders WHERE o_orderstatus = 'F'),
         latest AS (SELECT ticker, max(d) AS asof_date, arg_max(c, d) AS latest_close FROM prices GROUP BY 1)
    SELECT id, buys.ticker AS ticker, prices.d AS entry_date, prices.c AS entry_close, latest_close, asof_date,
           CAST(format('{:.1f}', (latest_close - prices.c) / prices.c * 100) AS DOUBLE) AS pct
    FROM buys ASOF JOIN prices ON buys.ticker = prices.ticker AND buys.tx_date >= prices.d JOIN latest ON latest.ticker = buys.ticker WHERE prices.c > 0
    """
)
def buy_returns(spark, sf_dir):
    """The return since each buy, from daily closes by brand."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    prices = items.groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("day")).agg(F.max("l_extendedprice").alias("close"))
    brand = F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 5).cast("string"), (1 + F.col("o_orderkey") % 5).cast("string"))
    bought = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), brand.alias("ticker"), F.col("o_orderdate").cast("date").alias("tx_date"), F.lit("buy").alias("type"))
    return returns.buy_returns(bought, prices)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def new_filings(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.new_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query(
    """
    SELECT user_id, event_type, event_id, value FROM (
      SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (CAST(ts AS DATE) >= DATE '2024-01-15') DESC, event_id DESC) AS r FROM events
      WHERE CAST(ts AS DATE) >= DATE '2024-01-15' OR event_id IN (SELECT min(event_id) FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15' GROUP BY user_id, event_type)
    ) WHERE r = 1
    """
)
def upsert_last_wins(spark, sf_dir):
    """The first event of each user and type before a day, overwritten by the later ones."""
    events = table(spark, sf_dir, "events").withColumn("late", F.col("ts").cast("date") >= F.lit("2024-01-15").cast("date"))
    columns = ["user_id", "event_type", "event_id", "value"]
    stored = events.filter("NOT late").groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("e")).select("user_id", "event_type", "e.*")
    return upserts.upsert(stored.select(columns), events.filter("late").select(columns), ["user_id", "event_type"], "event_id")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS filing_date FROM orders WHERE o_orderdate >= DATE '2000-01-01'")
def retention(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("filing_date"))
    return orders.filter(F.col("filing_date") >= scalars.prune_cutoff(F.lit("2001-08-01").cast("date")))


@query(f"WITH t AS ({TRADES}) SELECT id, member, tx_date, row_number() OVER (ORDER BY tx_date DESC, member, id) - 1 AS order_pos FROM t")
def canonical_order(spark, sf_dir):
    """Each trade's place in the total order."""
    return views.with_positions(trades(spark, sf_dir).select("id", "member", "tx_date"), [F.desc("tx_date"), F.asc("member"), F.asc("id")])


@query(
    """
    WITH members AS (SELECT r_name || ' Q. ' || n_name AS name, CASE WHEN r_regionkey < 2 THEN 'house' END AS chamber, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, m.name AS found
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN members m ON m.name = r_name || ' Q. ' || n_name AND c_nationkey % 3 <> 2 AND (m.chamber IS NULL OR m.chamber = CASE WHEN c_custkey % 2 = 0 THEN 'house' ELSE 'senate' END)
    """
)
def roster_fallback(spark, sf_dir):
    """Customers' made-up names looked up in a roster of nations: turned, with titles and suffixes, without middle initials, or unknown."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    full = F.concat_ws(" ", "r_name", F.lit("Q."), "n_name")
    none = F.lit(None).cast("string")
    members = nation.select(full.alias("name"), F.when(F.col("r_regionkey") < 2, "house").alias("chamber"), none.alias("party"), none.alias("state"), none.alias("district"), F.lit(None).cast("array<string>").alias("aliases"), F.col("n_nationkey").alias("position"))
    turned = F.concat(F.lit("Hon. "), F.col("r_name"), F.lit("  Q. "), F.col("n_name"), F.lit(", Jr."))
    loose = F.concat(F.upper("n_name"), F.lit(", "), F.lower("r_name"))
    kind = F.col("n_nationkey") % 3
    raw = F.when(kind == 0, turned).when(kind == 1, loose).otherwise("Nobody Known")
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = people.select("c_custkey", raw.alias("member"), F.when(F.col("c_custkey") % 2 == 0, "house").otherwise("senate").alias("chamber"))
    return joins.roster_lookup(rows, members).select("c_custkey", F.col("found.name").alias("found"))


@query(
    """
    WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT) AS a, o_orderpriority[1:1] AS p FROM orders)
    SELECT o_orderkey, CASE WHEN p IN ('1', '2', '3') THEN CASE p WHEN '2' THEN 0 ELSE a + 1 END END AS lo,
           CASE p WHEN '1' THEN a + 1000 WHEN '2' THEN a + 1 END AS hi
    FROM o
    """
)
def amount_brackets(spark, sf_dir):
    """Labels made from order totals, parsed back; two of five forms are no brackets."""
    a = (F.floor(F.col("o_totalprice") / 1000) * 1000).cast("long")
    p = F.left("o_orderpriority", F.lit(1))
    lo, hi = F.format_number(a + 1, 0), F.format_number(a + 1000, 0)
    label = F.when(p == "1", F.concat(F.lit(" $"), lo, F.lit("  – $"), hi)).when(p == "2", F.concat(F.lit("$ "), lo, F.lit(" or Less"))).when(p == "3", F.concat(F.lit("Over $"), lo)).when(p == "4", F.concat(F.lit("$"), lo)).otherwise("None")
    parsed = scalars.parse_amount(label)
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed["lo"].alias("lo"), parsed["hi"].alias("hi"))


@query(
    """
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
         g AS (SELECT doc_id, pos, line, sum(CAST(length(line) < 40 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS gid FROM l)
    SELECT doc_id, gid, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM g WHERE gid > 0 GROUP BY ALL
    """
)
def line_groups(spark, sf_dir):
    """Lines of each document grouped under the short line before them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return filings.line_groups(lines, "doc_id", F.length("line") < 40).groupBy("doc_id", "gid").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages")
def page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"))


MATCHES = "SELECT n_nationkey AS match_id, 0.5 + n_nationkey / 10.0 AS h, 0.4 + n_regionkey / 2.5 AS a FROM nation"
MATRIX = f"""
    WITH m AS ({MATCHES}), g AS (SELECT unnest(range(0, 11)) AS k), f AS (SELECT k, CAST(factorial(CAST(k AS INT)) AS DOUBLE) AS fk FROM g),
    c AS (SELECT match_id, x.k AS i, y.k AS j,
            greatest(0, exp(-h) * pow(h, x.k) / x.fk * exp(-a) * pow(a, y.k) / y.fk *
              CASE WHEN x.k = 0 AND y.k = 0 THEN 1 - h * a * -0.06 WHEN x.k = 0 AND y.k = 1 THEN 1 + h * -0.06 WHEN x.k = 1 AND y.k = 0 THEN 1 + a * -0.06 WHEN x.k = 1 AND y.k = 1 THEN 1.06 ELSE 1 END) AS raw
          FROM m, f x, f y),
    p AS (SELECT match_id, i, j, raw / sum(raw) OVER (PARTITION BY match_id) AS p FROM c)
"""


def matches(spark, sf_dir: str):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("match_id"), (0.5 + F.col("n_nationkey") / 10).alias("lam_home"), (0.4 + F.col("n_regionkey") / 2.5).alias("lam_away"), F.lit(-0.06).alias("rho"))


@query(MATRIX + "SELECT match_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(p, 9) AS p FROM p")
def score_matrix(spark, sf_dir):
    return probability.score_matrix(matches(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query(
    MATRIX
    + """
    SELECT match_id, round(sum(p) FILTER (i > j), 9) AS p_home, round(sum(p) FILTER (i = j), 9) AS p_draw, round(sum(p) FILTER (i < j), 9) AS p_away,
           round(sum(p) FILTER (i > 0 AND j > 0), 9) AS btts, round(sum(p) FILTER (j = 0), 9) AS clean_home, round(sum(p) FILTER (i = 0), 9) AS clean_away,
           round(sum(i * p), 9) AS xg_home, round(sum(j * p), 9) AS xg_away, round(sum(p) FILTER (i + j > 1.5), 9) AS over_1_5, round(sum(p) FILTER (i + j > 2.5), 9) AS over_2_5,
           round(sum(p) FILTER (i + j > 3.5), 9) AS over_3_5, round(1 - sum(p) FILTER (i + j > 1.5), 9) AS under_1_5, round(1 - sum(p) FILTER (i + j > 2.5), 9) AS under_2_5, round(1 - sum(p) FILTER (i + j > 3.5), 9) AS under_3_5
    FROM p GROUP BY match_id
    """
)
def match_markets(spark, sf_dir):
    found = probability.markets(probability.score_matrix(matches(spark, sf_dir)))
    return found.select("match_id", *(F.round(c, 9).alias(c) for c in found.columns if c != "match_id"))


@query(MATRIX + "SELECT match_id, CAST(r AS INT) AS rank, score, round(p, 9) AS p FROM (SELECT match_id, i || '-' || j AS score, p, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, i, j) AS r FROM p) WHERE r <= 7")
def top_scorelines(spark, sf_dir):
    return probability.top_scores(probability.score_matrix(matches(spark, sf_dir))).withColumn("p", F.round("p", 9))


def _won(side: str) -> str:
    return MATRIX.replace("0.5 + n_nationkey / 10.0 AS h", "(0.5 + n_nationkey / 10.0) / 3 AS h").replace("0.4 + n_regionkey / 2.5 AS a", "(0.4 + n_regionkey / 2.5) / 3 AS a") if side == "late" else MATRIX


@query(
    f"""
    WITH r AS ({MATRIX} SELECT match_id, sum(p) FILTER (i > j) AS w, sum(p) FILTER (i = j) AS d FROM p GROUP BY match_id),
         e AS ({_won("late")} SELECT match_id, sum(p) FILTER (i > j) AS w, sum(p) FILTER (i = j) AS d FROM p GROUP BY match_id)
    SELECT match_id, round(r.w + r.d * e.w + r.d * e.d * 0.5, 9) AS adv_home, round(1 - (r.w + r.d * e.w + r.d * e.d * 0.5), 9) AS adv_away, round(r.d * e.d, 9) AS p_pens,
           round(r.w, 9) AS win_reg, round(r.d, 9) AS p_draw_reg, round(r.d * e.w, 9) AS win_et, round(r.d * e.d * 0.5, 9) AS win_pens
    FROM r JOIN e USING (match_id)
    """
)
def knockout(spark, sf_dir):
    """Who advances, and by which way."""
    odds = probability.knockout(matches(spark, sf_dir))
    return odds.select("match_id", *(F.round(c, 9).alias(c) for c in odds.columns if c != "match_id"))


@query(
    """
    WITH m AS (SELECT c_mktsegment AS segment, avg(c_acctbal) / 500 AS mean FROM customer GROUP BY 1)
    SELECT segment, round(sum(exp(-mean) * pow(mean, k) / CAST(factorial(CAST(k AS INT)) AS DOUBLE)), 9) AS over_9_5 FROM m, (SELECT unnest(range(10, 31)) AS k) GROUP BY segment
    """
)
def over_under_poisson(spark, sf_dir):
    means = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg((F.avg("c_acctbal") / 500).alias("mean"))
    return means.select("segment", F.round(probability.poisson_over("mean", 9.5), 9).alias("over_9_5"))


@query(
    """
    WITH s AS (SELECT n_name AS name, 1.5 + n_nationkey / 10.0 AS h, 3.0 + n_regionkey / 4.0 AS d, 2.0 + (n_nationkey % 7) / 2.0 AS a FROM nation),
         f AS (SELECT name, 1 / h / (1 / h + 1 / d + 1 / a) AS h, 1 / d / (1 / h + 1 / d + 1 / a) AS d, 1 / a / (1 / h + 1 / d + 1 / a) AS a, 1 / h + 1 / d + 1 / a - 1 AS over FROM s)
    SELECT name, round(h, 9) AS home, round(d, 9) AS draw, round(a, 9) AS away, round(over, 9) AS overround,
           CASE WHEN greatest(h, d, a) >= 0.6 THEN 'HIGH' WHEN greatest(h, d, a) >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level,
           CASE WHEN h >= d AND h >= a THEN 'Home' WHEN d >= a THEN 'Draw' ELSE 'Away' END AS result
    FROM f
    """
)
def devig_confidence(spark, sf_dir):
    odds = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (1.5 + F.col("n_nationkey") / 10).alias("h"), (3 + F.col("n_regionkey") / 4).alias("d"), (2 + (F.col("n_nationkey") % 7) / 2).alias("a"))
    fair = odds.withColumn("f", probability.devig("h", "d", "a"))
    level = probability.confidence(F.greatest("f.home", "f.draw", "f.away"))["level"]
    return fair.select("name", *(F.round(f"f.{c}", 9).alias(c) for c in ("home", "draw", "away", "overround")), level.alias("level"), probability.modal_result("f.home", "f.draw", "f.away")["result"].alias("result"))


@query("SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) = 3 THEN '' ELSE '$.k: not 3' END AS violations FROM events")
def contract_violations(spark, sf_dir):
    """Events whose properties aren't exactly {"k": 3}."""
    rules = [("$", "k", "integer", "3", True)]
    checked = contracts.violations(table(spark, sf_dir, "events").select("event_id", "props"), rules, "props")
    return checked.select("event_id", F.array_join("violations", "; ").alias("violations"))


@query("SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' AND value >= 20 AND NOT regexp_matches(props, '\"k\": [0-4]') GROUP BY 1")
def health_failures(spark, sf_dir):
    """Unexpected failures by user."""
    responses = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", (F.col("value") * 20).alias("status"), F.col("props").alias("url"))
    return contracts.unexpected_failures(responses, '"k": [0-4]').groupBy("user_id").agg(F.count("*").alias("failures"))


@query(MATRIX + "SELECT match_id, round(sum(p) FILTER (i > j), 9) AS p_home, round(sum(p) FILTER (i = j), 9) AS p_draw, round(sum(p) FILTER (i < j), 9) AS p_away, true AS within FROM p GROUP BY match_id")
def monte_carlo(spark, sf_dir):
    """Exact probabilities of each match, and whether those of 200,000 draws differ from none by five standard deviations or more."""
    found = probability.convergence(probability.score_matrix(matches(spark, sf_dir)))
    bound = 5 * (0.25 / 200_000) ** 0.5
    return found.select("match_id", *(F.round(f"p_{c}", 9).alias(f"p_{c}") for c in ("home", "draw", "away")), (F.col("max_difference") < bound).alias("within"))
