"""Outlier treatments of residuals, and grids of curve parameters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.rating import capped_curve
from oddsmill.operators.selection import percentiles
from oddsmill.sources.storage import written

#: About a usual score; sums of squares are of differences from it.
CENTRE = 25.0
METHODS = ("raw", "capped", "shrunk", "winsor", "huber")


def team_residuals(rows: DataFrame) -> DataFrame:
    """Two rows a fixture: observed, expected, residual of each side."""
    side = lambda own, home: F.struct(F.col(f"{own}_team_id").alias("team_id"), F.lit(home).alias("is_home"), F.col(f"{own}_score").cast("double").alias("observed"), F.col(f"expected_{own}").alias("expected"))
    out = rows.select("fixture_id", "match_date", F.explode(F.array(side("home", 1), side("away", 0))).alias("x")).select("fixture_id", "match_date", "x.*")
    return out.withColumn("residual", F.col("observed") - F.col("expected"))


def flagged(rows: DataFrame, spread: float = 1.5, team_order: bool = False) -> DataFrame:
    """Add the sample's mean, deviation and quantiles and whether the residual lies outside.

    The rows are written once, as they are read for each of these.  With ``team_order`` they are dealt out by team and
    sorted first, so that windows over a team's matches neither shuffle nor sort what is added later.
    """
    rows = written(rows, "residuals")
    low, high = percentiles(rows, "residual", [0.05, 0.95])
    found = rows.agg(F.avg("residual").alias("mu"), F.stddev_samp("residual").alias("sd")).first()
    if team_order:
        rows = rows.repartition("team_id").sortWithinPartitions("team_id", "match_date", "fixture_id")
    out = rows.withColumns({c: F.lit(x).cast("double") for c, x in (("mu", found.mu), ("sd", found.sd), ("q05", low), ("q95", high))})
    return out.withColumn("outlier", ~F.col("residual").between(F.col("mu") - spread * F.col("sd"), F.col("mu") + spread * F.col("sd")))


def treated(rows: DataFrame, cap: float = 15.0, shrink: float = 0.75, spread: float = 1.5) -> DataFrame:
    """Add the adjusted observation of each method."""
    r = F.col("residual")

    def clip(low: Column, high: Column) -> Column:
        return F.least(F.greatest(r, low), high)

    ways = {
        "raw": r, "capped": clip(F.lit(-cap), F.lit(cap)), "shrunk": F.when(F.col("outlier"), r * shrink).otherwise(r),
        "winsor": clip(F.col("q05"), F.col("q95")), "huber": clip(F.col("mu") - spread * F.col("sd"), F.col("mu") + spread * F.col("sd")),
    }
    return rows.withColumns({f"observed_{m}": F.col("expected") + x for m, x in ways.items()})


def recent_ratio(observed: str, expected: str, games: int = 5) -> Column:
    """Weighted sum of past observations over that of expectations, newest games heaviest; NULL without history."""
    order = Window.partitionBy("team_id").orderBy("match_date", "fixture_id")
    past = lambda c: sum((games + 1 - k) * F.coalesce(F.lag(c, k).over(order), F.lit(0.0)) for k in range(1, games + 1))
    below = past(expected)
    return F.when(below > 0, past(observed) / below)


def predictions(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"predicted_{m}": F.col("expected") * recent_ratio(f"observed_{m}", "expected") for m in METHODS})


def _metrics(p: str = "predicted", o: str = "observed") -> list[Column]:
    e = F.col(p) - F.col(o)
    return [F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(o).alias("mean_observed"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(p, o).alias("correlation")]


def leaderboard(rows: DataFrame) -> DataFrame:
    """One row a method, with its improvement on ``raw``."""
    long = rows.select("observed", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"predicted_{m}").alias("predicted")) for m in METHODS])).alias("x")).select("observed", "x.*").dropna()
    table = long.groupBy("method").agg(*_metrics())
    raw = table.filter("method = 'raw'").select(F.col("mae").alias("raw_mae"))  # one row
    both = table.crossJoin(F.broadcast(raw))
    return both.withColumns({"gain": F.col("raw_mae") - F.col("mae"), "gain_percent": F.try_divide((F.col("raw_mae") - F.col("mae")) * 100, F.col("raw_mae"))}).drop("raw_mae")


def after_outlier(rows: DataFrame) -> DataFrame:
    """Rows whose team's match before was an outlier."""
    order = Window.partitionBy("team_id").orderBy("match_date", "fixture_id")
    return rows.withColumn("_was", F.lag("outlier", 1, False).over(order)).filter("_was").drop("_was")


def sensitivity(rows: DataFrame, multiplier: str) -> DataFrame:
    """How far the multiplier moves after an outlier."""
    order = Window.partitionBy("team_id").orderBy("match_date", "fixture_id")
    moved = rows.withColumn("_d", F.lead(multiplier).over(order) - F.col(multiplier)).filter("outlier").select(F.abs("_d").alias("_d")).dropna()
    moved = written(moved, "moves")
    median = F.lit(percentiles(moved, "_d", [0.5])[0]).cast("double")
    return moved.agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), F.max("_d").alias("most")).select("n", "mean", median.alias("median"), "most")


def largest(rows: DataFrame, n: int = 30) -> DataFrame:
    return rows.orderBy(F.abs("residual").desc(), "fixture_id", "team_id").limit(n)


def grid(cap_start: list[float], max_edit: list[float], rate: list[float]) -> list[tuple[int, float, float, float]]:
    return [(k, *p) for k, p in enumerate(product(cap_start, max_edit, rate))]


def repriced(rows: DataFrame, cap_start: Column | float = 0.75, max_edit: Column | float = 0.40, rate: Column | float = 0.80) -> DataFrame:
    """Add ``predicted``: team scores (expected, attack, opponent_defence) with curved multipliers in place of their own."""

    def ratio(c: str) -> Column:
        return F.try_divide(capped_curve(F.col(c), cap_start, max_edit, rate), F.col(c))

    return rows.withColumn("predicted", F.col("expected") * ratio("attack") * ratio("opponent_defence"))


MOMENTS = ("n", "p", "o", "e", "abs_e", "ee", "pp", "oo", "po")


def grid_moments(rows: DataFrame, points: list[tuple[int, float, float, float]]) -> DataFrame:
    """``point`` and sums over ``rows`` (observed, expected, attack, opponent_defence) of what errors are made of.

    A task adds its rows batch by batch to one matrix of points by moments, so that a row a
    task and point leaves it and no row is repeated for every point.  Scores are
    taken as differences from ``CENTRE``, so that their squares do not swallow the spread.
    A row with a missing value or a multiplier of 0 counts at no point.
    """
    caps, edits, rates = (np.array([p[k] for p in points]) for k in (1, 2, 3))
    columns = ["observed", "expected", "attack", "opponent_defence"]

    def curve(x: np.ndarray) -> np.ndarray:
        edit = (x[:, None] - 1.0) * rates
        reach = np.minimum(np.abs(edit) / caps, 1.0)
        return 1.0 + np.sign(edit) * edits * (2.0 * reach - reach * reach)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(points), len(MOMENTS)))
        for batch in batches:
            for at in range(0, len(batch), 2000):
                o, e, attack, defence = batch.iloc[at : at + 2000][columns].to_numpy(float).T
                sound = (attack != 0) & (defence != 0) & ~np.isnan(o + e + attack + defence)
                o, e, attack, defence = o[sound], e[sound], attack[sound], defence[sound]
                p = (e / (attack * defence))[:, None] * curve(attack) * curve(defence)
                error, spread = p - o[:, None], p - CENTRE
                own = o - CENTRE
                sums = [np.full(len(points), float(len(o))), spread.sum(axis=0), np.full(len(points), own.sum()), error.sum(axis=0), np.abs(error).sum(axis=0)]
                squares = [(error * error).sum(axis=0), (spread * spread).sum(axis=0), np.full(len(points), own @ own), own @ spread]
                total += np.column_stack(sums + squares)
        yield pd.DataFrame({"point": [p[0] for p in points], **dict(zip(MOMENTS, total.T, strict=True))})

    tasks = rows.select(*columns).mapInPandas(added, "point int, " + ", ".join(f"{m} double" for m in MOMENTS))
    return tasks.groupBy("point").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def curve_grid(rows: DataFrame, points: list[tuple[int, float, float, float]]) -> DataFrame:
    """Errors of team scores re-priced with the curve of each point, and their change against ``expected`` itself; rows: observed, expected, attack, opponent_defence."""
    m = {c: F.col(c) for c in MOMENTS}
    n = m["n"]
    cross, pp, oo = m["po"] - m["p"] * m["o"] / n, m["pp"] - m["p"] * m["p"] / n, m["oo"] - m["o"] * m["o"] / n
    metrics = {
        "n": n.cast("long"), "mean_predicted": CENTRE + m["p"] / n, "mean_observed": CENTRE + m["o"] / n, "bias": m["e"] / n, "mae": m["abs_e"] / n, "rmse": F.sqrt(m["ee"] / n),
        "correlation": F.try_divide(cross, F.sqrt(F.greatest(pp, F.lit(0.0)) * F.greatest(oo, F.lit(0.0)))),
    }
    # One row a point, and one row of the scores as they are.
    known = rows.sparkSession.createDataFrame(points, "point int, cap_start double, max_edit double, rate double")
    table = grid_moments(rows, points).filter("n > 0").join(F.broadcast(known), "point").select("point", "cap_start", "max_edit", "rate", *[x.alias(c) for c, x in metrics.items()])
    base = rows.agg(F.avg(F.abs(F.col("expected") - F.col("observed"))).alias("base"))
    change = F.col("mae") - F.col("base")
    return table.crossJoin(F.broadcast(base)).withColumns({"mae_change": change, "mae_change_percent": F.try_divide(change * 100, F.col("base"))}).drop("base")


def score_metrics(rows: DataFrame) -> DataFrame:
    """Metrics of home, away and all team scores; rows: is_home, observed, predicted."""
    copies = rows.select("observed", "predicted", F.explode(F.array(F.when(F.col("is_home") == 1, "home").otherwise("away"), F.lit("all"))).alias("sample"))
    return copies.groupBy("sample").agg(*_metrics())


def with_multipliers(fixtures: DataFrame, strength: DataFrame) -> DataFrame:
    """Fixtures with both sides' multipliers, from one grouping of the team rows instead of two joins."""
    side = lambda h, c: F.max(F.when(F.col("is_home") == h, F.col(c)))
    wide = strength.groupBy("fixture_id").agg(*[side(h, c).alias(f"{n}_{c}") for n, h in (("home", 1), ("away", 0)) for c in ("attack", "defence")])
    return fixtures.join(wide, "fixture_id", "left")


def best_point(table: DataFrame) -> DataFrame:
    """The grid point with the least error: by mae, then mse, then absolute bias. Points of one curve tie but for rounding."""
    return table.orderBy(F.round("mae", 9), F.round(F.col("rmse") * F.col("rmse"), 9), F.round(F.abs("bias"), 9), "point").limit(1)


def best_curve(rows: DataFrame, points: list[tuple[int, float, float, float]]) -> DataFrame:
    """Home, away and all team scores as they are and with the best curve of a grid, side by side."""
    best = best_point(curve_grid(rows, points)).select("point", "cap_start", "max_edit", "rate")  # one row
    curved = score_metrics(repriced(rows.crossJoin(F.broadcast(best)), F.col("cap_start"), F.col("max_edit"), F.col("rate")))
    base = score_metrics(rows.withColumn("predicted", F.col("expected")))
    names = ["bias", "mae", "rmse", "correlation"]
    both = base.select("sample", "n", *[F.col(c).alias(f"base_{c}") for c in names]).join(curved.select("sample", *[F.col(c).alias(f"curved_{c}") for c in names]), "sample")
    return both.withColumns({f"{c}_change": F.col(f"curved_{c}") - F.col(f"base_{c}") for c in names}).crossJoin(F.broadcast(best))


