"""Fair market prices from score distributions: rows (keys, market, selection, line, probability, decimal_price)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.functions.rating import price

RANGE = 20


def _priced(rows: DataFrame, keys: list[str], market: str, choices: dict[str, Column], line: Column) -> DataFrame:
    options = F.array(*[F.struct(F.lit(name).alias("selection"), p.alias("probability")) for name, p in choices.items()])
    out = rows.select(*keys, line.cast("double").alias("line"), F.explode(options).alias("x"))
    return out.select(*keys, F.lit(market).alias("market"), "x.selection", "line", "x.probability", price(F.col("x.probability")).alias("decimal_price"))


def match_odds(cells: DataFrame, keys: list[str]) -> DataFrame:
    h, a, p = F.col("home_score"), F.col("away_score"), F.col("p")
    rows = cells.groupBy(*keys).agg(*[F.sum(F.when(c, p).otherwise(0.0)).alias(n) for n, c in (("home", h > a), ("draw", h == a), ("away", h < a))])
    return _priced(rows, keys, "match_odds", {n: F.col(n) for n in ("home", "draw", "away")}, F.lit(None))


def margins(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, (F.col("home_score") - F.col("away_score")).alias("margin")).agg(F.sum("p").alias("p"))


def totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, (F.col("home_score") + F.col("away_score")).alias("total")).agg(F.sum("p").alias("p"))


def handicap_mainline(home: Column, away: Column) -> Column:
    return F.floor(-(home - away)) + 0.5


def handicap_lines(pmf: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Prices of the given lines (keys, line): home covers if margin + line > 0, else away, a push included."""
    home = F.sum(F.when(F.col("margin") + F.col("line") > 0, F.col("p")).otherwise(0.0))
    rows = lines.join(pmf, keys).groupBy(*keys, "line").agg(home.alias("home"))
    return _priced(rows, keys, "handicap", {"home": F.col("home"), "away": 1.0 - F.col("home")}, F.col("line"))


def handicap_ladder(pmf: DataFrame, means: DataFrame, keys: list[str], home: str, away: str, reach: int = RANGE) -> DataFrame:
    main = handicap_mainline(F.col(home), F.col(away))
    lines = means.select(*keys, F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: main + k)).alias("line"))
    return handicap_lines(pmf, lines, keys)


def totals_ladder(pmf: DataFrame, keys: list[str], reach: int = RANGE) -> DataFrame:
    """Lines a half above whole numbers, ``reach`` to both sides of the matrix mean."""
    if reach <= 0:
        raise ValueError("reach must be positive")
    mean = pmf.groupBy(*keys).agg(F.sum(F.col("total") * F.col("p")).alias("mean"))
    # Means that are whole up to rounding count as whole.
    tidy = F.round("mean", 9)
    steps = F.sequence(F.floor(tidy - reach).cast("int"), F.ceil(tidy + reach).cast("int"))
    lines = mean.select(*keys, F.explode(F.transform(steps, lambda k: k + F.lit(0.5))).alias("line"))
    over = F.sum(F.when(F.col("total") > F.col("line"), F.col("p")).otherwise(0.0))
    rows = lines.join(pmf, keys).groupBy(*keys, "line").agg(over.alias("over"))
    return _priced(rows, keys, "totals", {"over": F.col("over"), "under": 1.0 - F.col("over")}, F.col("line"))


def totals_mainline(ladder: DataFrame, keys: list[str]) -> DataFrame:
    """The line whose over is nearest to even, the lowest of equals."""
    gap = F.round(F.abs(F.col("probability") - 0.5), 12)
    return ladder.filter("selection = 'over'").groupBy(*keys).agg(F.min_by("line", F.struct(gap, F.col("line"))).alias("line"))


def display(ladder: DataFrame, main: DataFrame, keys: list[str], choices: tuple[str, str], reach: int = RANGE) -> DataFrame:
    """Every second line around the main one, both selections side by side."""
    rows = ladder.join(main.select(*keys, F.col("line").alias("main")), keys)
    step = F.round(F.col("line") - F.col("main")).cast("int")
    rows = rows.filter((F.pmod(step, F.lit(2)) == 0) & (F.abs(step) <= reach))
    picked = [F.max(F.when(F.col("selection") == c, F.col(v))).alias(f"{c}_{v}") for c in choices for v in ("probability", "decimal_price")]
    return rows.groupBy(*keys, "line").agg(*picked)


def ladders_of_arrays(rows: DataFrame, keys: list[str], home: str, away: str, max_score: int, reach: int = RANGE) -> DataFrame:
    """All prices of fixtures with the arrays of ``margin_and_total``: one row a selection, no join and no shuffle."""
    last = 2 * max_score + 1
    main = handicap_mainline(F.col(home), F.col(away))
    mean = F.round("mean_total", 9)

    def at_least(values: str, place: Column) -> Column:
        return F.col(values)[F.least(F.greatest(place, F.lit(0)), F.lit(last)).cast("int")]

    def pair(market: str, line: Column, names: tuple[str, str], p: Column) -> Column:
        row = lambda n, q: F.struct(F.lit(market).alias("market"), F.lit(n).alias("selection"), line.cast("double").alias("line"), q.alias("probability"))
        return F.array(row(names[0], p), row(names[1], 1.0 - p))

    win = at_least("margin_from", F.lit(max_score + 1))
    chances = {"home": win, "draw": F.col("draw"), "away": 1.0 - win - F.col("draw")}
    odds = F.array(*[F.struct(F.lit("match_odds").alias("market"), F.lit(n).alias("selection"), F.lit(None).cast("double").alias("line"), p.alias("probability")) for n, p in chances.items()])
    handicaps = F.flatten(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: pair("handicap", main + k, ("home", "away"), at_least("margin_from", F.floor(-(main + k)) + 1 + max_score))))
    lines = F.sequence(F.floor(mean - reach).cast("int"), F.ceil(mean + reach).cast("int"))
    overs = F.flatten(F.transform(lines, lambda k: pair("totals", k + F.lit(0.5), ("over", "under"), at_least("total_from", k + 1))))
    out = rows.select(*keys, F.explode(F.concat(odds, handicaps, overs)).alias("x"))
    return out.select(*keys, "x.*", price(F.col("x.probability")).alias("decimal_price"))
