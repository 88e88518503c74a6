"""Queries of the score model from configurations to results, with nations as matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators import probability
from ledgerlark.plans.registry import query, table
from ledgerlark.sources import readers

#: Mean scores of all matches, rounded as the exact binary values, and what comes of them; the third of the matches with given mean scores keep those.
MODEL = """
    WITH n AS (SELECT n_nationkey AS match_id, 'H' || CAST(n_nationkey AS VARCHAR) AS home, 'A' || CAST(n_nationkey AS VARCHAR) AS away, 0.6 + n_nationkey % 7 * CAST(0.15 AS DOUBLE) AS attack, 0.8 + n_regionkey * CAST(0.1 AS DOUBLE) AS defense FROM nation),
    l AS (SELECT *, CASE WHEN match_id % 3 = 0 THEN CAST(1.2 AS DOUBLE) ELSE CAST(format('{:.3f}', CAST(1.35 AS DOUBLE) * attack * CAST(1.0 AS DOUBLE) * CAST(0.95 AS DOUBLE)) AS DOUBLE) END AS h,
                 CASE WHEN match_id % 3 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(format('{:.3f}', CAST(1.15 AS DOUBLE) * CAST(1.0 AS DOUBLE) * defense * CAST(1.0 AS DOUBLE)) AS DOUBLE) END AS a, CASE WHEN match_id % 4 = 0 THEN CAST(-0.08 AS DOUBLE) ELSE CAST(-0.06 AS DOUBLE) END AS rho FROM n),
    k AS (SELECT unnest(range(0, 11)) AS k), f AS (SELECT k, CAST(factorial(CAST(k AS INT)) AS DOUBLE) AS fk FROM k),
    c AS (SELECT match_id, x.k AS i, y.k AS j, greatest(0, exp(-h) * pow(h, x.k) / x.fk * exp(-a) * pow(a, y.k) / y.fk *
            CASE WHEN x.k = 0 AND y.k = 0 THEN 1 - h * a * rho WHEN x.k = 0 AND y.k = 1 THEN 1 + h * rho WHEN x.k = 1 AND y.k = 0 THEN 1 + a * rho WHEN x.k = 1 AND y.k = 1 THEN 1 - rho ELSE 1 END) AS raw FROM l, f x, f y),
    p AS (SELECT match_id, i, j, raw / sum(raw) OVER (PARTITION BY match_id) AS p FROM c),
    m AS (SELECT match_id, sum(p) FILTER (i > j) AS p_home, sum(p) FILTER (i = j) AS p_draw, sum(p) FILTER (i < j) AS p_away, sum(p) FILTER (i + j > 2.5) AS over_2_5, sum(i * p) AS xg_home, sum(j * p) AS xg_away FROM p GROUP BY match_id),
    o AS (SELECT n_nationkey AS match_id, CASE WHEN n_nationkey % 5 <> 0 THEN 1.5 + n_nationkey / 10.0 END AS oh, CASE WHEN n_nationkey % 5 <> 0 THEN 3.0 + n_regionkey / 4.0 END AS od, CASE WHEN n_nationkey % 5 <> 0 THEN 2.0 + (n_nationkey % 7) / 2.0 END AS oa, n_nationkey % 6 = 0 AS shaky FROM nation),
    d AS (SELECT match_id, shaky, 1 / oh / (1 / oh + 1 / od + 1 / oa) AS fh, 1 / od / (1 / oh + 1 / od + 1 / oa) AS fd, 1 / oa / (1 / oh + 1 / od + 1 / oa) AS fa, 1 / oh + 1 / od + 1 / oa - 1 AS overround FROM o),
    j AS (SELECT m.*, l.home, l.away, l.h, l.a, l.rho, fh, fd, fa, overround, coalesce(shaky, false) AS shaky, CASE WHEN fh IS NOT NULL THEN greatest(abs(p_home - fh), abs(p_draw - fd), abs(p_away - fa)) END AS gap, greatest(p_home, p_draw, p_away) AS top FROM m JOIN l USING (match_id) JOIN d USING (match_id)),
    r AS (SELECT *, greatest(0, CASE WHEN top >= 0.6 THEN 2 WHEN top >= 0.45 THEN 1 ELSE 0 END - CAST(coalesce(gap > 0.07, false) AS INT) - CAST(shaky AS INT)) AS level FROM j)
"""


def configurations(spark, sf_dir: str) -> DataFrame:
    """Matches in the form of match documents (JSON texts), as MODEL has them."""
    key, region, none = F.col("n_nationkey"), F.col("n_regionkey"), F.lit(None).cast("double")
    name = lambda side: F.concat(F.lit(side), key.cast("string"))
    team = lambda side, attack, defense, context: F.struct(name(side).alias("name"), attack.alias("attack"), defense.alias("defense"), context.alias("context"))
    one = F.lit(1.0)
    home = team("H", 0.6 + key % 7 * 0.15, 0.8 + region * 0.1, F.lit(0.95))
    away = team("A", one, one, one)
    calibration = F.struct(none.alias("base_home"), none.alias("base_away"), F.when(key % 4 == 0, -0.08).alias("rho"), home.alias("home"), away.alias("away"))
    odds = F.when(key % 5 != 0, F.array(1.5 + key / 10, 3.0 + region / 4, 2.0 + (key % 7) / 2))
    third = F.when(key % 2 == 0, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))
    override = F.when(key % 3 == 0, F.struct(F.lit(1.2).alias("home"), F.lit(0.9).alias("away")))
    corners = F.when(key % 4 == 1, F.struct((4.0 + key / 10).alias("home_corners")))
    cards = F.when(key % 4 == 2, F.struct((3.0 + key / 10).alias("referee_yellow_avg"), F.lit(1.1).alias("mismatch_bump")))
    meta = F.struct(F.lit("not shown").alias("_note"), name("H").alias("home"), F.lit("V").alias("venue"))
    whole = F.struct(meta.alias("meta"), calibration.alias("calibration"), F.struct(odds.alias("odds"), third.alias("supercomputer")).alias("market"), override.alias("lambdas_override"), (key % 6 == 0).alias("data_unstable"), corners.alias("corners"), cards.alias("cards"))
    return table(spark, sf_dir, "nation").select(key.alias("match_id"), F.to_json(whole).alias("value"))


def matches(spark, sf_dir: str) -> DataFrame:
    """Match documents, read back as columns for predict()."""
    parsed = configurations(spark, sf_dir).select("match_id", F.from_json("value", readers.MATCH_SCHEMA).alias("m")).select("match_id", "m.*")
    return readers.match_columns(parsed, F.col("match_id"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(
    MODEL
    + """
    SELECT match_id, home, away, h AS lam_home, a AS lam_away, round(p_home, 9) AS p_home, round(p_draw, 9) AS p_draw, round(p_away, 9) AS p_away, round(over_2_5, 9) AS over_2_5, round(xg_home, 9) AS xg_home, round(overround, 9) AS overround,
           round(gap, 9) AS divergence, ['LOW', 'MEDIUM', 'HIGH'][level + 1] AS level,
           concat_ws('; ', '1X2 favorite at ' || format('{:.0f}', top * 100) || '%', CASE WHEN gap > 0.07 THEN 'market diverges ' || format('{:.0f}', gap * 100) || ' pts (down one level)' WHEN gap IS NOT NULL THEN 'aligned with the market' END,
                     CASE WHEN shaky THEN 'unstable base data (down one level)' END, CASE WHEN level = 0 THEN 'even match: the model has NO strong read' END) AS reason,
           CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'Home' WHEN p_draw >= p_away THEN 'Draw' ELSE 'Away' END AS result,
           (SELECT CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) FROM p WHERE p.match_id = r.match_id ORDER BY p DESC, i, j LIMIT 1) AS scoreline
    FROM r
    """
)
def predictions(spark, sf_dir):
    """All matches from their documents to the recommendation."""
    found = probability.predict(matches(spark, sf_dir))
    out = found.select("match_id", "home", "away", "lam_home", "lam_away", "p_home", "p_draw", "p_away", "over_2_5", "xg_home", F.col("fair.overround").alias("overround"), "divergence", F.col("confidence.level").alias("level"), F.col("confidence.reason").alias("reason"), F.col("recommended.result").alias("result"), "scoreline")
    return _rounded(out, "p_home", "p_draw", "p_away", "over_2_5", "xg_home", "overround", "divergence")


@query(
    """
    WITH n AS (SELECT n_nationkey AS match_id, CASE n_nationkey % 4 WHEN 1 THEN 'corners' ELSE 'cards' END AS market, CASE n_nationkey % 4 WHEN 1 THEN 4.0 + n_nationkey / 10.0 + 4.3 ELSE (3.0 + n_nationkey / 10.0) * 0.85 * 1.1 END AS mean FROM nation WHERE n_nationkey % 4 IN (1, 2)),
         l AS (SELECT 'corners' AS market, unnest([8.5, 9.5, 10.5]) AS line UNION ALL SELECT 'cards', unnest([3.5, 4.5, 5.5])), k AS (SELECT unnest(range(0, 31)) AS k),
         o AS (SELECT match_id, n.market, mean, line, sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) FILTER (k > line) AS over FROM n JOIN l USING (market), k GROUP BY ALL)
    SELECT match_id, market, round(CAST(mean AS DOUBLE), 9) AS mean, CAST(line AS DOUBLE) AS line, round(over, 9) AS over, round(1 - over, 9) AS under FROM o
    """
)
def extra_markets(spark, sf_dir):
    """Corners and cards over and under their lines."""
    return _rounded(probability.extra_markets(matches(spark, sf_dir)), "mean", "over", "under")


@query(
    MODEL
    + """
    SELECT match_id, 0 AS place, 'Own model' AS source, round(p_home, 9) AS home, round(p_draw, 9) AS draw, round(p_away, 9) AS away FROM r
    UNION ALL SELECT match_id, 1, 'Market (de-vig)', round(fh, 9), round(fd, 9), round(fa, 9) FROM r WHERE fh IS NOT NULL
    UNION ALL SELECT match_id, 2, 'Supercomputer', 0.5, 0.3, 0.2 FROM r WHERE match_id % 2 = 0
    """
)
def validation_rows(spark, sf_dir):
    """The model beside the market and a third source."""
    return _rounded(probability.validation_rows(probability.predict(matches(spark, sf_dir))), "home", "draw", "away")


@query(
    MODEL
    + """
    SELECT match_id, home || ' vs ' || away AS title, round(p_home, 9) AS p_home, round(xg_home + xg_away, 9) AS goals, ['LOW', 'MEDIUM', 'HIGH'][level + 1] AS level, 7 AS n_scores,
           home || ': base 1.35 x attack ' || format('{:.2f}', attack) || ' x opposing defence 1.00 x context 0.95 -> ' || format('{:.3f}', h) AS calibration
    FROM r JOIN (SELECT match_id, attack FROM n) USING (match_id)
    """
)
def result_documents(spark, sf_dir):
    """The JSON result of each match, read back in part, and the first line on its calibration."""
    from ledgerlark.sources import sinks

    full = probability.full_results(matches(spark, sf_dir), with_knockout=True)
    shape = "match string, markets struct<`1x2`:struct<home:double>,expected_total_goals:double,top_scorelines:array<struct<score:string,prob:double>>>, confidence struct<level:string>"
    found = sinks.result_json(full).select("match_id", F.from_json("result", shape).alias("r")).join(full.select("match_id", F.split("calibration", "\n")[0].alias("calibration")), "match_id")
    out = found.select("match_id", F.col("r.match").alias("title"), F.col("r.markets.1x2.home").alias("p_home"), F.col("r.markets.expected_total_goals").alias("goals"), F.col("r.confidence.level").alias("level"), F.size("r.markets.top_scorelines").alias("n_scores"), "calibration")
    return _rounded(out, "p_home", "goals")


@query(
    MODEL
    + """
    SELECT match_id, 'Home ' || format('{:.1f}', p_home * 100) || '%  Draw ' || format('{:.1f}', p_draw * 100) || '%  Away ' || format('{:.1f}', p_away * 100) || '%' AS result, match_id % 4 = 1 AS has_corners, match_id % 4 = 2 AS has_cards, true AS has_knockout,
           9 AS n_sections, CASE WHEN fh IS NOT NULL OR match_id % 2 = 0 THEN 1 + CAST(fh IS NOT NULL AS INT) + CAST(match_id % 2 = 0 AS INT) ELSE 0 END AS n_sources
    FROM r
    """
)
def report_texts(spark, sf_dir):
    """The text report of each match: its result line, which sections it has and how many sources."""
    from ledgerlark.sources import sinks

    report = sinks.match_report(probability.full_results(matches(spark, sf_dir), with_knockout=True))
    text = F.col("report")
    sources = F.regexp_count(text, F.lit(r"\n  (Own model|Market \(de-vig\)|Supercomputer): "))
    return report.select(
        "match_id", F.regexp_extract(text, r"\[3\] 1X2\n  ([^\n]*)", 1).alias("result"), text.contains("[5b] CORNERS").alias("has_corners"), text.contains("[5c] CARDS").alias("has_cards"),
        text.contains("[K] KNOCKOUT").alias("has_knockout"), F.regexp_count(text, F.lit(r"(^|\n)\[[1-9]\] ")).alias("n_sections"), sources.alias("n_sources"),
    )
