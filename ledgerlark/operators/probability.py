"""Score probabilities for any number of matches at once: matrices, markets, knockouts, odds, confidence.

A match is a row with an id, two mean scores and a dependency rho; its matrix is 121 rows made by
exploding two sequences, so all matches run in one stage and meet again by their id.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerlark.functions.scalars import as_column, exact_round, literal_map, low_score_factor, poisson_pmf

# Defaults of the model, rho by style, confidence levels and bounds.
DEFAULTS = {"base_home": 1.35, "base_away": 1.15, "rho": -0.06, "factor": 1.0}
STYLE_RHO = {"low_block": -0.08, "cagey": -0.07, "balanced": -0.06, "open": -0.04, "end_to_end": -0.03}
LEVELS = ("LOW", "MEDIUM", "HIGH")
HIGH, MEDIUM, DIVERGENCE = 0.60, 0.45, 0.07
GOAL_LINES, CORNER_LINES, CARD_LINES = (1.5, 2.5, 3.5), (8.5, 9.5, 10.5), (3.5, 4.5, 5.5)
CORNERS = {"home_corners": 5.2, "away_corners": 4.3}
CARDS = {"referee_yellow_avg": 4.0, "wc_discount": 0.85, "mismatch_bump": 1.0}
# Words of flags, reasons and sources.
ALIGNED, REVIEW = "OK (aligned)", "REVIEW calibration (>7 pts)"
REASONS = {
    "favourite": "1X2 favorite at %.0f%%",
    "far": "market diverges %.0f pts (down one level)",
    "near": "aligned with the market",
    "shaky": "unstable base data (down one level)",
    "even": "even match: the model has NO strong read",
}
SOURCES = ("Own model", "Market (de-vig)", "Supercomputer")


def lambdas(matches: DataFrame) -> DataFrame:
    """Mean scores from base rates and attack, defence and context factors, missing ones by default, to 3 digits; given ones stay."""
    get = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    own = lambda us, them: exact_round(get(f"base_{us}", DEFAULTS[f"base_{us}"]) * get(f"{us}_attack", 1.0) * get(f"{them}_defense", 1.0) * get(f"{us}_context", 1.0), 3)
    given = F.col("override_home").isNotNull() & F.col("override_away").isNotNull()
    return matches.withColumns({
        "lam_home": F.when(given, F.col("override_home")).otherwise(own("home", "away")),
        "lam_away": F.when(given, F.col("override_away")).otherwise(own("away", "home")),
        "rho": get("rho", DEFAULTS["rho"]),
    })


def style_rho(style) -> Column:
    return F.coalesce(F.try_element_at(literal_map(STYLE_RHO), as_column(style)), F.lit(DEFAULTS["rho"]))


def score_matrix(matches: DataFrame, key: str = "match_id", max_goals: int = 10) -> DataFrame:
    """(key, i, j, p): the normalised probability of each score of up to ``max_goals`` a side; negative cells count as 0."""
    goals = F.sequence(F.lit(0), F.lit(max_goals))
    pmfs = matches.select(key, "lam_home", "lam_away", "rho", F.transform(goals, lambda k: poisson_pmf(k, "lam_home")).alias("ph"), F.transform(goals, lambda k: poisson_pmf(k, "lam_away")).alias("pa"))
    cells = pmfs.select("*", F.posexplode("ph").alias("i", "p_i")).select("*", F.posexplode("pa").alias("j", "p_j"))
    raw = F.greatest(F.lit(0.0), F.col("p_i") * F.col("p_j") * low_score_factor("i", "j", "lam_home", "lam_away", "rho"))
    total = F.sum("raw").over(Window.partitionBy(key))
    out = cells.withColumn("raw", raw).withColumn("total", total)
    guarded = F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(F.raise_error(F.lit("a score matrix without mass")).cast("double"))
    return out.select(key, "i", "j", guarded.alias("p"))


def markets(matrix: DataFrame, key: str = "match_id", lines=GOAL_LINES) -> DataFrame:
    """By match: home, draw and away, both score, clean sheets, expected goals, and over and under each line."""
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    mass = lambda condition, name: F.sum(F.when(condition, p).otherwise(0.0)).alias(name)
    overs = [mass(i + j > line, _line("over", line)) for line in lines]
    out = matrix.groupBy(key).agg(
        mass(i > j, "p_home"), mass(i == j, "p_draw"), mass(i < j, "p_away"),
        mass((i > 0) & (j > 0), "btts"), mass(j == 0, "clean_home"), mass(i == 0, "clean_away"),
        F.sum(i * p).alias("xg_home"), F.sum(j * p).alias("xg_away"), *overs,
    )
    return out.withColumns({_line("under", line): 1 - F.col(_line("over", line)) for line in lines})


def _line(side: str, line: float) -> str:
    return f"{side}_{str(line).replace('.', '_')}"


def top_scores(matrix: DataFrame, key: str = "match_id", n: int = 7) -> DataFrame:
    """The n most probable scores of each match, ranked; ties in order of home and away goals."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "i", "j"))
    return matrix.filter("p <> 0").withColumn("rank", rank).filter(F.col("rank") <= n).select(key, "rank", F.concat_ws("-", "i", "j").alias("score"), "p")


def knockout(matches: DataFrame, key: str = "match_id", extra: float = 1.0 / 3.0, penalties: float = 0.5) -> DataFrame:
    """By match: who advances, through regular time, extra time at ``extra`` of the mean scores, and penalties."""
    regular = matches.select(key, "lam_home", "lam_away", "rho", F.lit(False).alias("late"))
    late = matches.select(key, F.col("lam_home") * extra, F.col("lam_away") * extra, "rho", F.lit(True))
    phases = regular.union(late).withColumn("_phase", F.struct(key, "late"))
    odds = markets(score_matrix(phases, "_phase"), "_phase", ()).select("_phase.*", "p_home", "p_draw")
    pick = lambda c, phase: F.max(F.when(F.col("late") == phase, F.col(c)))
    out = odds.groupBy(key).agg(pick("p_home", False).alias("win_reg"), pick("p_draw", False).alias("p_draw_reg"), pick("p_home", True).alias("_home_et"), pick("p_draw", True).alias("_draw_et"))
    out = out.withColumns({"win_et": F.col("p_draw_reg") * F.col("_home_et"), "p_pens": F.col("p_draw_reg") * F.col("_draw_et")})
    out = out.withColumn("win_pens", F.col("p_pens") * penalties).withColumn("adv_home", F.col("win_reg") + F.col("win_et") + F.col("win_pens"))
    return out.withColumn("adv_away", 1 - F.col("adv_home")).drop("_home_et", "_draw_et")


def devig(home, draw, away) -> Column:
    """(home, draw, away, overround): probabilities in proportion to the inverse odds, and what these add up to above 1."""
    inverse = [1 / as_column(c) for c in (home, draw, away)]
    total = inverse[0] + inverse[1] + inverse[2]
    return F.struct(*((p / total).alias(n) for p, n in zip(inverse, ("home", "draw", "away"), strict=True)), (total - 1).alias("overround"))


def divergence(model, market) -> Column:
    """The largest difference between two sets of three probabilities."""
    return F.greatest(*(F.abs(as_column(m) - as_column(k)) for m, k in zip(model, market, strict=True)))


def divergence_flag(d) -> Column:
    return F.when(as_column(d) <= DIVERGENCE, ALIGNED).otherwise(REVIEW)


def confidence(top, market_divergence=None, unstable=None) -> Column:
    """(level, reason): by the favourite's probability, one level down each for a market that diverges and for unstable data."""
    top = as_column(top)
    far = F.coalesce(as_column(market_divergence) > DIVERGENCE, F.lit(False)) if market_divergence is not None else F.lit(False)
    known = as_column(market_divergence).isNotNull() if market_divergence is not None else F.lit(False)
    shaky = F.coalesce(as_column(unstable), F.lit(False)) if unstable is not None else F.lit(False)
    level = F.when(top >= HIGH, 2).when(top >= MEDIUM, 1).otherwise(0)
    index = F.greatest(F.lit(0), level - far.cast("int") - shaky.cast("int"))
    points = as_column(market_divergence) * 100 if market_divergence is not None else F.lit(None).cast("double")
    reason = F.concat_ws(
        "; ",
        F.format_string(REASONS["favourite"], top * 100),
        F.when(far, F.format_string(REASONS["far"], points)).when(known, REASONS["near"]),
        F.when(shaky, REASONS["shaky"]),
        F.when(index == 0, REASONS["even"]),
    )
    return F.struct(F.element_at(F.array(*map(F.lit, LEVELS)), index + 1).alias("level"), reason.alias("reason"))


def modal_result(home, draw, away) -> Column:
    """(result, p) of the most probable outcome; ties go to home, then draw."""
    home, draw, away = map(as_column, (home, draw, away))
    return F.when((home >= draw) & (home >= away), F.struct(F.lit("Home").alias("result"), home.alias("p"))).when(draw >= away, F.struct(F.lit("Draw").alias("result"), draw.alias("p"))).otherwise(F.struct(F.lit("Away").alias("result"), away.alias("p")))


def poisson_over(mean, line: float, most: int = 30) -> Column:
    """The Poisson probability of more than ``line``, of counts up to ``most``; what lies beyond counts as under."""
    return F.aggregate(F.sequence(F.lit(int(line) + 1), F.lit(most)), F.lit(0.0), lambda total, k: total + poisson_pmf(k, mean))


def corners_total(home, away) -> Column:
    return F.coalesce(as_column(home), F.lit(CORNERS["home_corners"])) + F.coalesce(as_column(away), F.lit(CORNERS["away_corners"]))


def cards_mean(average, discount, bump) -> Column:
    given = zip((average, discount, bump), CARDS.values(), strict=True)
    parts = [F.coalesce(as_column(c), F.lit(v)) for c, v in given]
    return parts[0] * parts[1] * parts[2]


def predict(matches: DataFrame, key: str = "match_id") -> DataFrame:
    """All matches through matrix, markets, odds, confidence and recommendation.

    ``matches``: see lambdas(), and odds_home, odds_draw, odds_away and data_unstable, which may be null.
    """
    ready = lambdas(matches)
    matrix = score_matrix(ready, key)
    best = top_scores(matrix, key, 1).select(key, F.col("score").alias("scoreline"), F.col("p").alias("scoreline_p"))
    out = ready.join(markets(matrix, key), key).join(best, key)
    fair = F.when(F.col("odds_home").isNotNull(), devig("odds_home", "odds_draw", "odds_away"))
    out = out.withColumn("fair", fair).withColumn("divergence", divergence(("p_home", "p_draw", "p_away"), ("fair.home", "fair.draw", "fair.away")))
    out = out.withColumn("divergence", F.when(F.col("fair").isNotNull(), F.col("divergence")))
    return out.withColumns({"confidence": confidence(F.greatest("p_home", "p_draw", "p_away"), "divergence", "data_unstable"), "recommended": modal_result("p_home", "p_draw", "p_away")})


def full_results(matches: DataFrame, key: str = "match_id", with_knockout: bool = False, samples: int = 0) -> DataFrame:
    """predict() with all that a report or a JSON result shows: calibration, scores, validation and extras as arrays, and knockout and sampled as structs, null unless asked for.

    ``matches``: as for predict(), and home, away, corners, cards and supercomputer.
    """
    ready = lambdas(matches)
    matrix = score_matrix(ready, key)
    out = predict(matches, key).withColumn("calibration", calibration_text())
    listed = lambda order, *columns: F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    scores = top_scores(matrix, key).groupBy(key).agg(listed("rank", "score", "p").alias("scores"))
    validation = validation_rows(out, key).groupBy(key).agg(listed("place", "source", "home", "draw", "away").alias("validation"))
    lines = extra_markets(matches, key).groupBy(key, "market", "mean").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "over"))), lambda x: x["over"]).alias("overs"))
    extras = lines.groupBy(key).agg(F.collect_list(F.struct("market", "mean", "overs")).alias("extras"))
    out = out.join(scores, key).join(validation, key).join(extras, key, "left").withColumn("extras", F.coalesce("extras", F.expr("CAST(array() AS array<struct<market:string,mean:double,overs:array<double>>>)")))
    odds = knockout(ready, key)
    as_struct = F.struct(*(F.col(c) for c in odds.columns if c != key))
    out = out.join(odds.select(key, as_struct.alias("knockout")), key, "left") if with_knockout else out.withColumn("knockout", F.lit(None).cast(odds.select(as_struct.alias("x")).schema["x"].dataType))
    sampled = convergence(matrix, samples, key=key).select(key, F.struct("max_difference").alias("sampled")) if samples else None
    return out.join(sampled, key, "left") if samples else out.withColumn("sampled", F.lit(None).cast("struct<max_difference:double>"))


def simulate(matrix: DataFrame, n: int = 200_000, seed: int = 42, key: str = "match_id") -> DataFrame:
    """Frequencies of home, draw and away among ``n`` draws of each match's matrix.

    How often each of a match's cells is drawn is itself drawn, all at once: a multinomial number
    for each cell, whatever ``n`` is. The same seed and match give the same numbers on any cluster.
    """
    cells = matrix.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "j", "p"))).alias("cells"))
    cells = cells.select(key, *(F.col(f"cells.{name}").cast("array<double>").alias(name) for name in ("i", "j", "p")))
    outcomes = ("p_home", "p_draw", "p_away")
    schema = StructType([matrix.schema[key], *(StructField(name, DoubleType()) for name in outcomes)])

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, i, j, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
                share, away = np.array(p), np.sign(np.array(j) - np.array(i))
                hits = rng.multinomial(n, share / share.sum()) / n
                rows.append([float(hits[away == side].sum()) for side in (-1, 0, 1)])
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *outcomes])

    return cells.mapInArrow(draw, schema)


def extra_markets(matches: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, market, mean, line, over, under) of corners and cards, for matches that give ``corners`` or ``cards``; missing parts by default."""
    corners = matches.filter("corners IS NOT NULL").select(key, F.lit("corners").alias("market"), corners_total("corners.home_corners", "corners.away_corners").alias("mean"), F.array(*map(F.lit, CORNER_LINES)).alias("lines"))
    cards = matches.filter("cards IS NOT NULL").select(key, F.lit("cards"), cards_mean("cards.referee_yellow_avg", "cards.wc_discount", "cards.mismatch_bump"), F.array(*map(F.lit, CARD_LINES)))
    tails = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: poisson_pmf(k, "mean"))
    rows = corners.union(cards).withColumn("tails", tails).select("*", F.explode("lines").alias("line"))
    over = F.aggregate(F.slice("tails", (F.floor("line") + 2).cast("int"), F.lit(31)), F.lit(0.0), lambda a, p: a + p)
    return rows.select(key, "market", "mean", "line", over.alias("over"), (1 - over).alias("under"))


def validation_rows(predictions: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, place, source, home, draw, away): the model's probabilities, the market's and a third source's, where there are such."""
    own = predictions.select(key, F.lit(0).alias("place"), F.lit(SOURCES[0]).alias("source"), F.col("p_home").alias("home"), F.col("p_draw").alias("draw"), F.col("p_away").alias("away"))
    market = predictions.filter("fair IS NOT NULL").select(key, F.lit(1), F.lit(SOURCES[1]), "fair.home", "fair.draw", "fair.away")
    out = own.union(market)
    if "supercomputer" in predictions.columns:
        third = predictions.filter("size(supercomputer) = 3").select(key, F.lit(2), F.lit(SOURCES[2]), *(F.element_at("supercomputer", k) for k in (1, 2, 3)))
        out = out.union(third)
    return out


def convergence(matrix: DataFrame, n: int = 200_000, seed: int = 42, key: str = "match_id") -> DataFrame:
    """By match the exact and drawn probabilities of home, draw and away and their largest difference."""
    exact = markets(matrix, key, ()).select(key, "p_home", "p_draw", "p_away")
    drawn = simulate(matrix, n, seed, key).select(key, *(F.col(f"p_{c}").alias(f"mc_{c}") for c in ("home", "draw", "away")))
    gap = F.greatest(*(F.abs(F.col(f"p_{c}") - F.col(f"mc_{c}")) for c in ("home", "draw", "away")))
    return exact.join(drawn, key).withColumn("max_difference", gap)


def calibration_text() -> Column:
    """A line for each side on how its mean score came about."""

    def side(us: str, them: str) -> Column:
        given = [F.format_string("%.2f", F.coalesce(F.col(c), F.lit(d))) for c, d in ((f"base_{us}", DEFAULTS[f"base_{us}"]), (f"{us}_attack", 1.0), (f"{them}_defense", 1.0), (f"{us}_context", 1.0))]
        return F.concat(F.col(us), F.lit(": base "), given[0], F.lit(" x attack "), given[1], F.lit(" x opposing defence "), given[2], F.lit(" x context "), given[3], F.lit(" -> "), F.format_string("%.3f", F.col(f"lam_{us}")))

    return F.concat_ws("\n", side("home", "away"), side("away", "home"))
