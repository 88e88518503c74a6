import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import contracts, joins, probability, returns, upserts, views

DAY = dt.date(2026, 1, 1)


def test_asof_join_equals_a_scan_of_all_prices(spark):
    rng = random.Random(1)
    day = lambda: DAY + dt.timedelta(rng.randrange(400))
    keys = ["hot"] * 8 + ["a", "b", None]
    prices = [(rng.choice(keys), day(), float(rng.randrange(90))) for _ in range(300)]
    asked = [(k, rng.choice([*keys, "unknown"]), day()) for k in range(400)] + [(999, "hot", None)]
    got = joins.asof_join(spark.createDataFrame(asked, "id int, ticker string, tx_date date"), spark.createDataFrame(prices, "ticker string, day date, close double"), "ticker", "tx_date", "day", "close", "d", "c")
    found = {r.id: (r.d, r.c) for r in got.collect()}
    assert len(found) == len(asked)
    for k, ticker, d in asked:
        before = [(p[1], p[2]) for p in prices if ticker is not None and d is not None and p[0] == ticker and p[1] <= d]
        assert found[k] == (max(before) if before else (None, None)), (k, ticker, d)


def test_returns_need_a_price_before_the_trade(spark):
    d = lambda n: DAY + dt.timedelta(n)
    prices = spark.createDataFrame([("A", d(0), 100.0), ("A", d(3), 110.0), ("Z", d(0), 0.0)], "ticker string, day date, close double")
    trades = spark.createDataFrame([("1", "A", d(1), "buy"), ("2", "A", d(-1), "buy"), ("3", "A", d(3), "buy"), ("4", "B", d(1), "buy"), ("5", "A", d(1), "sell"), ("6", "Z", d(1), "buy"), ("7", "", d(1), "buy")], "id string, ticker string, tx_date date, type string")
    got = returns.buy_returns(trades, prices)
    assert {r.id: r.pct for r in got.collect()} == {"1": 10.0, "3": 0.0}
    assert tuple(returns.coverage(trades, got).first()) == (5, 2, 1)
    assert [r.ticker for r in returns.buy_tickers(trades).collect()] == ["A", "B", "Z"] and [r.ticker for r in returns.buy_tickers(trades, 2).collect()] == ["A", "B"]
    assert [tuple(r) for r in returns.ticker_prices(got).collect()] == [("A", d(3), 110.0)]


def test_returns_come_of_the_closes_as_they_are(spark):
    prices = spark.createDataFrame([("A", DAY, 0.00123), ("A", DAY + dt.timedelta(1), 0.00187), ("B", DAY, 0.00004), ("B", DAY + dt.timedelta(1), 0.00005)], "ticker string, day date, close double")
    trades = spark.createDataFrame([("1", "A", DAY, "buy"), ("2", "B", DAY, "buy")], "id string, ticker string, tx_date date, type string")
    got = {r.id: (r.entry_close, r.latest_close, r.pct) for r in returns.buy_returns(trades, prices).collect()}
    assert got == {"1": (0.0012, 0.0019, 52.0), "2": (0.0, round(0.00005, 4), 25.0)}


def roster(spark):
    rows = [("Osric Vantongeren", "house", "R", "QT", "QT-10", ["Os Vantongeren"]), ("Amby Pellwether", "senate", "R", "QA", None, ["Pellwether, Ambrose H."]), ("This Quarrington", "senate", "R", "QK", None, ["Thistle Quarrington"]), ("Any One", None, "", None, None, None), ("Os Vantongeren", "senate", "D", "ZZ", None, None)]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "name string, chamber string, party string, state string, district string, aliases array<string>, position int")


def test_roster_lookup_and_enrichment(spark):
    asked = [("Hon. Osric T. Vantongeren", "house"), ("Pellwether, Ambrose H.", "senate"), ("A. Thistle Quarrington, Jr.", "senate"), ("Os Vantongeren", "senate"), ("Any One", "house"), ("Nobody", "house"), (None, "house")]
    trades = spark.createDataFrame([(k, m, c, "X", None, None) for k, (m, c) in enumerate(asked)], "k int, member string, chamber string, party string, state string, district string")
    got = [tuple(r)[1:] for r in joins.enrich(trades, roster(spark)).orderBy("k").collect()]
    assert got[0] == ("Osric Vantongeren", "house", "R", "QT", "QT-10") and got[1][0] == "Amby Pellwether" and got[2][0] == "This Quarrington"
    assert got[3] == ("Os Vantongeren", "senate", "X", None, None)  # the first of that name is in the other chamber
    assert got[4] == ("Any One", "house", "X", None, None) and got[5][0] == "Nobody" and got[6][0] is None


def test_filters_sorts_and_pages(spark):
    rows = [("1", "Ann", "NVDA", "house", "buy", DAY, 5), ("2", "Bob", None, "house", "sell", DAY, None), ("3", "Nv%d", "X", "senate", "buy", DAY - dt.timedelta(50), 7)]
    trades = spark.createDataFrame(rows, "id string, member string, ticker string, chamber string, type string, tx_date date, amount_lo long")
    ids = lambda **q: [r.id for r in views.page(trades, views.TradeQuery(**q)).collect()]
    assert ids(text="NV", sort="member") == ["1", "3"] and ids(text="v%", sort="member") == ["3"]
    assert ids(sort="amount_lo") == ["3", "1", "2"] and ids(sort="amount_lo", descending=False) == ["2", "1", "3"]
    asked = views.TradeQuery().sorted_by("member")
    assert not asked.downwards and asked.sorted_by("member").downwards and asked.sorted_by("amount_lo").downwards and asked.sorted_by("source_url") == asked
    assert [r.id for r in views.ticker_trades(trades, "X").collect()] == ["3"] and views.ticker_trades(trades, "X", "2026-01-01").isEmpty()
    assert ids(as_of="2026-01-01", days=10, sort="member") == ["1", "2"] and ids(chamber="senate", sort="member") == ["3"]


def test_views(spark):
    rows = [(k, "A" if k < 6 else "B", n, "buy" if k % 2 else "sell", f"m{k % 3}", DAY, 1, 3 if k % 2 else None, k) for k, n in enumerate(["x", "y", "y", "x", "z", "q", "w", "w"])]
    trades = spark.createDataFrame(rows, "id int, ticker string, asset string, type string, member string, tx_date date, amount_lo long, amount_hi long, order_pos int")
    assert {r.ticker: r.asset for r in views.modal_asset(trades, "ticker").collect()} == {"A": "x", "B": "w"}
    top = views.top_tickers(trades, "2026-01-02").collect()
    assert [(r.ticker, r.buys, r.sells, r.total) for r in top] == [("A", 3, 3, 6), ("B", 1, 1, 2)] and top[1].bar == pytest.approx(1 / 3)
    assert [(r.member, r.total) for r in views.member_split(trades).collect()] == [("m0", 3), ("m1", 3), ("m2", 2)]
    placed = views.with_positions(trades.drop("order_pos").repartition(3), [F.desc("id")]).collect()
    assert sorted((r.order_pos, r.id) for r in placed) == [(7 - k, k) for k in range(7, -1, -1)][::1]
    skipped = spark.createDataFrame([("m1", "paper")], "member string, reason string")
    cards = {r.member: r for r in views.featured_cards(trades, skipped, spark.createDataFrame([("m1",), ("new",)], "member string"), "2026-01-02").collect()}
    assert (cards["m1"].n, cards["m1"].paper, cards["m1"].latest.asset) == (3, 1, "y") and cards["new"].n == 0
    shown = views.return_of(trades.withColumn("asset_type", F.when(F.col("id") == 3, "Option")), spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0)], "id int, pct double"))
    assert [r.id for r in shown.filter("pct IS NOT NULL").collect()] == [1]


def test_upserts_and_changes(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    incoming = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, seq long")
    merged = upserts.upsert(stored, incoming, ["id"], "seq")
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert upserts.changed(stored, merged) and not upserts.changed(merged, merged.orderBy("v")) and upserts.changed(stored, stored.union(stored.limit(1)))
    old = spark.createDataFrame([("x", ["p"]), ("y", ["q"])], "name string, aliases array<string>")
    new = spark.createDataFrame([("x", ["r", "x"])], "name string, aliases array<string>")
    assert sorted((r.name, r.aliases) for r in upserts.merge_rosters(old, new).collect()) == [("x", ["p", "r"]), ("y", ["q"])]


def test_contracts(spark):
    good = {k: "s" for k in ("environ", "error", "eventDescription", "ip", "logLevelName", "node", "pod", "request")} | dict.fromkeys(("application", "endpoint", "event", "logLevel"), 1)
    good |= {"applicationName": "login", "endpointName": "refresh", "eventCode": "unauthorized", "eventName": "Unauthorized", "when": "2026-01-01T00:00:00Z"}
    of = lambda **change: json.dumps({"event": {k: v for k, v in (good | change).items() if v is not None}})
    cases = [of(), of(node=None), of(more="x"), of(event="1"), of(eventName="other"), of(when="2026-13-01T00:00:00Z"), of(application=1.0), of(application=1.5), "nonsense", "{}"]
    rows = contracts.violations(spark.createDataFrame(list(enumerate(cases)), "k int, payload string"), contracts.LOGIN_REFRESH).orderBy("k").collect()
    assert [r.violations for r in rows] == [[], ["$.event.node: missing"], ["$.event: extra more"], ["$.event.event: not a integer"], ["$.event.eventName: not Unauthorized"], ["$.event.when: not a date-time"], [], ["$.event.application: not a integer"], ["$: not an object"], ["$.event: missing"]]
    probes = spark.createDataFrame([("dev", True), ("prod", False)], "env string, seen boolean")
    assert all(r.holds for r in contracts.rollout(probes, {"dev": True, "prod": False}).collect())
    with pytest.raises(Exception, match="unknown environment"):
        contracts.rollout(probes, {"dev": True}).collect()
    failures = contracts.unexpected_failures(spark.createDataFrame([("p", 404, "/x"), ("p", 401, "/refresh"), ("q", 200, "/")], "page string, status int, url string"), "refresh")
    health = contracts.page_health(spark.createDataFrame([("p",), ("q",)], "page string"), failures.limit(0), failures)
    assert {r.page: r.healthy for r in health.collect()} == {"p": False, "q": True} and tuple(contracts.health_gate(health).first()) == (1, 1, False)
    reach = contracts.reachability(spark.createDataFrame([(None, None), ("deny", None), (None, "timeout")], "deny string, error string"))
    assert sorted((r.outcome, r.ok) for r in reach.collect()) == [("blocked", False), ("reachable", True), ("unreachable", False)]


def test_score_model(spark):
    m = spark.createDataFrame([(1, 2.22, 0.85, -0.06), (2, 0.0, 1.0, -0.06), (3, 1.3, 1.3, 0.0)], "match_id int, lam_home double, lam_away double, rho double")
    matrix = probability.score_matrix(m)
    odds = {r.match_id: r for r in probability.markets(matrix).collect()}
    for r in odds.values():
        assert r.p_home + r.p_draw + r.p_away == pytest.approx(1, abs=1e-9) and r.over_2_5 + r.under_2_5 == pytest.approx(1)
    assert [round(100 * x, 1) for x in (odds[1].p_home, odds[1].p_draw, odds[1].p_away)] == [68.0, 19.6, 12.5]
    assert odds[2].p_home == 0 and odds[3].p_home == pytest.approx(odds[3].p_away)
    best = probability.top_scores(matrix).filter("match_id = 3").orderBy("rank").collect()
    assert len(best) == 7 and best[0].score == "1-1" and [r.score for r in best[1:3]] == ["0-1", "1-0"]
    adv = {r.match_id: r for r in probability.knockout(m).collect()}
    assert adv[3].adv_home == pytest.approx(0.5) and adv[1].adv_home + adv[1].adv_away == pytest.approx(1)
    drawn = {r.match_id: r for r in probability.simulate(matrix, 40_000).collect()}
    assert all(abs(drawn[k].p_home - odds[k].p_home) < 0.012 for k in drawn)


def test_confidence_and_predictions(spark):
    rows = [(0.7, None, None), (0.6, 0.08, None), (0.5, 0.01, True), (0.4, 0.2, True), (0.8, 0.07, False)]
    df = spark.createDataFrame(rows, "top double, div double, bad boolean").select(probability.confidence("top", "div", "bad").alias("c"))
    assert [r.c.level for r in df.collect()] == ["HIGH", "MEDIUM", "LOW", "LOW", "HIGH"]
    assert df.first().c.reason == "1X2 favorite at 70%"
    columns = "match_id int, base_home double, base_away double, rho double, home_attack double, home_defense double, home_context double, away_attack double, away_defense double, away_context double, override_home double, override_away double, odds_home double, odds_draw double, odds_away double, data_unstable boolean"
    n = [None] * 9
    matches = spark.createDataFrame([(1, *n, None, None, 2.0, 3.5, 4.0, None), (2, *n, 3.0, 0.5, None, None, None, True)], columns)
    got = {r.match_id: r for r in probability.predict(matches).collect()}
    assert (got[1].lam_home, got[1].lam_away) == (1.35, 1.15) and got[1].fair.overround == pytest.approx(0.5 + 1 / 3.5 + 0.25 - 1)
    assert got[2].lam_home == 3.0 and got[2].divergence is None and got[2].recommended.result == "Home" and got[2].confidence.level == "MEDIUM"
    over = spark.range(1).select(probability.poisson_over(probability.corners_total(F.lit(None).cast("double"), F.lit(4.0)), 9.5), probability.cards_mean(*[F.lit(None).cast("double")] * 3), probability.style_rho(F.lit("open")), probability.style_rho(F.lit("?"))).first()
    assert 0.3 < over[0] < 0.6 and over[1] == pytest.approx(3.4) and (over[2], over[3]) == (-0.04, -0.06)


def test_extra_markets_and_validation(spark):
    import math

    rows = [(1, (5.0, None), None), (2, None, (4.0, None, 1.1))]
    m = spark.createDataFrame(rows, "match_id int, corners struct<home_corners:double,away_corners:double>, cards struct<referee_yellow_avg:double,wc_discount:double,mismatch_bump:double>")
    got = {(r.match_id, r.line): r for r in probability.extra_markets(m).collect()}
    over = lambda mean, line: sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(31) if k > line)
    assert len(got) == 6 and got[1, 9.5].over == pytest.approx(over(9.3, 9.5)) and got[2, 3.5].over == pytest.approx(over(4 * 0.85 * 1.1, 3.5))
    p = spark.createDataFrame([(1, 0.5, 0.3, 0.2, (0.4, 0.3, 0.3), [0.6, 0.2, 0.2]), (2, 0.5, 0.3, 0.2, None, None)], "match_id int, p_home double, p_draw double, p_away double, fair struct<home:double,draw:double,away:double>, supercomputer array<double>")
    assert sorted((r.match_id, r.place) for r in probability.validation_rows(p).collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_entry_points(spark, capsys, tmp_path):
    from ledgerlark.__main__ import main

    assert main(["quick", "1.5", "1.0", "--odds", "2.0", "3.4", "4.1", "--knockout"]) == 0
    shown = capsys.readouterr().out
    assert "[4] VALIDATION" in shown and "Market (de-vig)" in shown and "[K] KNOCKOUT" in shown
    assert main(["quick", "1.5", "1.0", "--home", "X", "--json"]) == 0 and json.loads(capsys.readouterr().out)["match"] == "X vs Away"
    (tmp_path / "a.html").write_text("<table><tr><th>Transaction Date</th><th>Amount</th></tr><tr><td>1</td><td>05/04/2026</td><td>Self</td><td>Q</td><td>Quill</td><td>Stock</td><td>Purchase</td><td>$1,001 - $15,000</td></tr></table>")
    assert main(["parse-ptr", f"{tmp_path}/a.html", "--member", "M"]) == 0
    trade = json.loads(capsys.readouterr().out)
    assert (trade["id"], trade["member"], trade["amount_hi"], trade["party"]) == ("senate:local:0", "M", 15000, None)
    (tmp_path / "a.txt").write_text("scan")
    assert main(["parse-ptr", f"{tmp_path}/a.txt"]) == 1 and main(["parse-ptr", f"{tmp_path}/a.rtf"]) == 2
    (tmp_path / "l.json").write_text(json.dumps([{"name": {"first": "Ann", "last": "Lee"}, "terms": [{"type": "sen", "state": "QQ", "party": "Democrat"}]}]))
    (tmp_path / "old.json").write_text(json.dumps({"members": [{"name": "Bo Old", "aliases": ["B"]}, {"name": "Ann Lee", "aliases": ["A. L."]}]}))
    assert main(["roster", f"{tmp_path}/l.json", f"{tmp_path}/old.json", f"{tmp_path}/new"]) == 0
    made = json.loads("".join(p.read_text() for p in sorted((tmp_path / "new").glob("part-*"))))["members"]
    assert [(m["name"], m["aliases"]) for m in made] == [("Ann Lee", ["A. L.", "Lee, Ann"]), ("Bo Old", ["B"])]


def test_digests_tell_nulls_and_their_places_apart(spark):
    kind = "a string, b string, c array<string>"
    one, other = (spark.createDataFrame([r], kind) for r in ((None, "x", ["y", None]), ("x", None, ["y", None])))
    moved = spark.createDataFrame([(None, "x", [None, "y"])], kind)
    assert upserts.changed(one, other) and upserts.changed(one, moved) and not upserts.changed(one, one.select("*"))
