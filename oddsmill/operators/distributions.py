"""Score distributions as long rows (keys..., home_score, away_score, p)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.rating import age_years, step_weight

CELL = ["home_score", "away_score"]


def normalised(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells divided by the mass of their key."""
    if not keys:
        total = cells.agg(F.sum("p").alias("_t"))
        return cells.crossJoin(F.broadcast(total)).withColumn("p", F.col("p") / F.col("_t")).drop("_t")
    return cells.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*keys)))


def historical(results: DataFrame, as_of: str, keys: list[str] | None = None, max_score: int = 100, strict: bool = False, weight=step_weight) -> DataFrame:
    """Weighted scorelines of past results; scores beyond ``max_score`` count as it. Only cells that occur."""
    rows = results.dropna(subset=CELL)
    if strict:
        rows = rows.filter(F.col("match_date") < F.lit(as_of).cast("date"))
    w = weight(age_years(F.lit(as_of).cast("date"), F.col("match_date")))
    cells = rows.groupBy(*(keys or []), *[F.least(F.col(c), F.lit(max_score)).alias(c) for c in CELL]).agg(F.sum(w).alias("p"))
    return normalised(cells, keys or [])


def log_factorials(most: int) -> list[float]:
    return np.cumsum([0.0] + [np.log(k) for k in range(1, most + 1)]).tolist()


def score_numbers(spark, max_score: int) -> DataFrame:
    """``k, log_factorial`` for 0 to ``max_score``."""
    return spark.createDataFrame(list(enumerate(log_factorials(max_score))), "k int, log_factorial double")


def poisson(rows: DataFrame, mean: str, max_score: int = 100, tail: str = "renormalise") -> DataFrame:
    """Rows of ``rows`` for every score k with its Poisson probability ``p``.

    ``tail``: ``renormalise`` over 0..max, ``fold`` the mass beyond into the last
    score, or ``leave`` it out.  A mean of 0 is a point mass; negative means are NULL.
    """
    m, k = F.col(mean), F.col("k")
    numbers = F.broadcast(score_numbers(rows.sparkSession, max_score))  # max_score + 1 rows
    p = F.when(m > 0, F.exp(-m + k * F.log(m) - F.col("log_factorial"))).when(m == 0, (k == 0).cast("double"))
    out = rows.crossJoin(numbers).withColumn("p", p).drop("log_factorial")
    mass = F.aggregate(F.sequence(F.lit(1), F.lit(max_score)), F.struct(F.exp(-m).alias("t"), F.exp(-m).alias("s")), lambda a, i: F.struct((a["t"] * m / i).alias("t"), (a["s"] + a["t"] * m / i).alias("s")), lambda a: a["s"])
    if tail == "renormalise":
        return out.withColumn("p", F.col("p") / mass)
    if tail == "fold":
        return out.withColumn("p", F.when(k == max_score, F.col("p") + 1.0 - mass).otherwise(F.col("p")))
    return out


def poisson_cells(rows: DataFrame, keys: list[str], home: str, away: str, max_score: int = 100, tail: str = "renormalise") -> DataFrame:
    """Joint cells of independent scores; the two marginals meet only here."""
    h = poisson(rows.select(*keys, home), home, max_score, tail).select(*keys, F.col("k").alias("home_score"), F.col("p").alias("ph"))
    a = poisson(rows.select(*keys, away), away, max_score, tail).select(*keys, F.col("k").alias("away_score"), F.col("p").alias("pa"))
    return h.join(a, keys).select(*keys, *CELL, (F.col("ph") * F.col("pa")).alias("p"))


def shifted(history: DataFrame, targets: DataFrame, keys: list[str], home: str, away: str, max_score: int = 100, strength: float = 1.0) -> DataFrame:
    """History scaled towards target means: scores times (target / mean) ** strength, split over neighbouring whole scores.

    The split of home and of away scores is separate, so a target's matrix is the matrix of
    historical counts between two bands, each with two entries a score.  The counts (one a
    scoreline that occurs) go to every task; a target's matrix is made where the target lies.
    A target of 0 or less has all scores at 0; a missing target gives no cells.
    """
    if not 0 <= strength <= 1:
        raise ValueError("strength must be between 0 and 1")
    lines = history.dropna(subset=CELL).groupBy(*CELL).agg(F.count("*").alias("n")).toPandas()  # a row a scoreline
    axes = [np.unique(lines[c].to_numpy(dtype=float)) for c in CELL]
    counts = np.zeros((len(axes[0]), len(axes[1])))
    counts[tuple(np.searchsorted(x, lines[c].to_numpy(dtype=float)) for x, c in zip(axes, CELL, strict=True))] = lines["n"]
    shared = targets.sparkSession.sparkContext.broadcast((axes, counts))
    rows = targets.select(*keys, F.col(home).cast("double").alias("_home"), F.col(away).cast("double").alias("_away")).dropna(subset=["_home", "_away"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def band(scores: np.ndarray, weights: np.ndarray, target: float) -> np.ndarray:
        """``moved score x score``: the shares of each historical score that go to whole scores."""
        mean = (scores * weights).sum() / weights.sum()
        factor = (target / mean) ** strength if target > 0 else 0.0
        x = np.clip(scores * factor, 0.0, float(max_score))
        low, place = np.floor(x).astype(int), np.arange(len(x))
        out = np.zeros((max_score + 2, len(x)))
        out[low, place] = 1 - (x - low)
        out[low + 1, place] += x - low
        return out[:-1]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (home_scores, away_scores), m = shared.value
        for batch in batches:
            for r in batch.to_dict("records") if m.size else []:
                p = band(home_scores, m.sum(axis=1), r["_home"]) @ m @ band(away_scores, m.sum(axis=0), r["_away"]).T
                i, j = np.nonzero(p)
                yield pd.DataFrame({**{k: [r[k]] * len(i) for k in keys}, "home_score": i.astype(np.int32), "away_score": j.astype(np.int32), "p": p[i, j] / p.sum()})

    return rows.mapInPandas(made, f"{kinds}, home_score int, away_score int, p double")


def blended(a: DataFrame, b: DataFrame, keys: list[str], weight_b: float) -> DataFrame:
    if not 0 <= weight_b <= 1:
        raise ValueError("weight must be between 0 and 1")
    both = a.select(*keys, *CELL, (F.col("p") * (1 - weight_b)).alias("p")).unionByName(b.select(*keys, *CELL, (F.col("p") * weight_b).alias("p")))
    return normalised(both.groupBy(*keys, *CELL).agg(F.sum("p").alias("p")), keys)


def matrix_rules(cells: DataFrame, keys: list[str], max_score: int = 100) -> DataFrame:
    """Mass, least cell and largest score of each matrix, and whether it is a distribution on the grid."""
    rows = cells.groupBy(*keys).agg(F.sum("p").alias("mass"), F.min("p").alias("least"), F.max(F.greatest(*CELL)).alias("largest"))
    return rows.withColumn("ok", (F.abs(F.col("mass") - 1) < 1e-8) & (F.col("least") >= 0) & (F.col("largest") <= max_score))


def implied_means(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum(F.col("home_score") * F.col("p")).alias("home_mean"), F.sum(F.col("away_score") * F.col("p")).alias("away_mean"))


def dense(cells: DataFrame, max_score: int, floor: float = 0.0) -> DataFrame:
    """One matrix on the full grid."""
    n = cells.sparkSession.range(max_score + 1)
    grid = n.select(F.col("id").cast("int").alias("home_score")).crossJoin(n.select(F.col("id").cast("int").alias("away_score")))
    return F.broadcast(grid).join(cells, CELL, "left").select(*CELL, (F.coalesce("p", F.lit(0.0)) + floor).alias("p"))


def smoothed(counts: DataFrame, max_score: int, smoothing: float = 1e-6) -> DataFrame:
    """Weighted counts (p) on the full grid, each cell with a little mass, as a distribution."""
    return normalised(dense(counts, max_score, smoothing), [])


def bucketed(cells: DataFrame, keys: list[str], width: int, max_score: int) -> DataFrame:
    small = cells.filter((F.col("home_score") <= max_score) & (F.col("away_score") <= max_score))
    return small.groupBy(*keys, *[(F.floor(F.col(c) / width) * width).cast("int").alias(c) for c in CELL]).agg(F.sum("p").alias("p"))


def solve_tilt(marginal: np.ndarray, targets: np.ndarray, steps: int = 100, tolerance: float = 1e-10, bound: float = 10.0) -> np.ndarray:
    """Exponents t with mean of ``marginal * exp(t * k)`` at each target, all targets at once by bisection.

    Two Newton steps follow where they stay in the bracket: they meet the mean to rounding, so that prices do not
    depend on where the bisection stopped.
    """
    k = np.arange(len(marginal), dtype=float)
    log_p = np.where(marginal > 0, np.log(np.maximum(marginal, 1e-300)), -np.inf)

    def moments(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = log_p + t[:, None] * k
        w = np.exp(x - x.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        mean = (w * k).sum(axis=1)
        return mean, (w * (k - mean[:, None]) ** 2).sum(axis=1)

    low, high = np.full(len(targets), -bound), np.full(len(targets), bound)
    for _ in range(steps):
        mid = (low + high) / 2
        mean, _ = moments(mid)
        low, high = np.where(mean < targets, mid, low), np.where(mean < targets, high, mid)
        if (high - low).max(initial=0) < tolerance:
            break
    out = (low + high) / 2
    for _ in range(2):
        mean, spread = moments(out)
        new = out + (targets - mean) / np.maximum(spread, 1e-300)
        out = np.where((np.abs(new - out) <= 2 * tolerance) & (spread > 0), new, out)
    return out


def _grid(base: DataFrame, max_score: int) -> np.ndarray:
    """One matrix as an array: at most (max_score + 1) ** 2 cells."""
    out = np.zeros((max_score + 1, max_score + 1))
    for r in base.select(*CELL, "p").collect():
        out[r.home_score, r.away_score] += r.p
    return out / out.sum()


def tilts(base: DataFrame, targets: DataFrame, home: str, away: str, max_score: int = 100) -> DataFrame:
    """Add ``theta_home`` and ``theta_away``: each side's marginal of ``base`` tilted to its target mean."""
    grid = _grid(base, max_score)
    marginals = targets.sparkSession.sparkContext.broadcast((grid.sum(axis=1), grid.sum(axis=0)))

    @F.pandas_udf("h double, a double")
    def solved(h: pd.Series, a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"h": solve_tilt(marginals.value[0], h.to_numpy(float)), "a": solve_tilt(marginals.value[1], a.to_numpy(float))})

    return targets.withColumn("_t", solved(F.col(home), F.col(away))).withColumns({"theta_home": F.col("_t.h"), "theta_away": F.col("_t.a")}).drop("_t")


def tilted_cells(base: DataFrame, tilted: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of ``base`` times exp(theta), for every row of ``tilted``, each a distribution."""
    x = F.log("p") + F.col("theta_home") * F.col("home_score") + F.col("theta_away") * F.col("away_score")
    rows = tilted.select(*keys, "theta_home", "theta_away").join(F.broadcast(base.filter("p > 0").select(*CELL, "p"))).withColumn("_x", x)
    rows = rows.withColumn("_m", F.max("_x").over(Window.partitionBy(*keys)))
    return normalised(rows.select(*keys, *CELL, F.exp(F.col("_x") - F.col("_m")).alias("p")), keys)


def solve_joint_tilt(p: np.ndarray, home: np.ndarray, away: np.ndarray, steps: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Two exponents a target with both means of ``p * exp(t0 * i + t1 * j)`` at the targets, by Newton steps for all targets at once.

    The weights are a product but for ``p``, so a step needs three products with the matrix and no target's cells.
    """
    p = np.maximum(p, 1e-12)
    i, j = (np.arange(n, dtype=float) for n in p.shape)
    wanted, t = np.column_stack([home, away]).astype(float), np.zeros((len(home), 2))
    open_ = np.arange(len(t))
    for _ in range(steps):
        x, y = t[open_, :1] * i, t[open_, 1:] * j
        x, y = np.exp(x - x.max(axis=1, keepdims=True)), np.exp(y - y.max(axis=1, keepdims=True))
        rows = [x * ((y * w) @ p.T) for w in (1.0, j, j * j)]
        mass = rows[0].sum(axis=1)
        mean = np.column_stack([(rows[0] * i).sum(axis=1), rows[1].sum(axis=1)]) / mass[:, None]
        gap = wanted[open_] - mean
        left = np.abs(gap).max(axis=1) >= tolerance
        if not left.any():
            return t
        ii, jj, ij = (v / mass for v in ((rows[0] * i * i).sum(axis=1), rows[2].sum(axis=1), (rows[1] * i).sum(axis=1)))
        c = np.empty((len(open_), 2, 2))
        c[:, 0, 0], c[:, 1, 1] = ii - mean[:, 0] ** 2 + 1e-10, jj - mean[:, 1] ** 2 + 1e-10
        c[:, 0, 1] = c[:, 1, 0] = ij - mean[:, 0] * mean[:, 1]
        step = np.clip(np.linalg.solve(c, gap[:, :, None])[:, :, 0], -1.0, 1.0)
        t[open_[left]] += step[left]
        open_ = open_[left]
    raise ValueError(f"no tilt meets the means {wanted[open_[0]].tolist()}")


#: Base matrices of the joint tilt are sent to every task up to this size.
BASES_BYTES = 32 << 20


def joint_tilts(bases: DataFrame, targets: DataFrame, group: str, key: str, home: str, away: str, max_score: int, steps: int = 100, tolerance: float = 1e-8, most_bytes: int = BASES_BYTES) -> DataFrame:
    """``key, theta_home, theta_away``: both means at once, by Newton steps with their covariance.

    bases: group and cells; targets: group, key and two means.  Targets are solved in batches where they
    lie; their group's matrix is broadcast.  Matrices of more than ``most_bytes`` together
    meet their targets by a shuffle instead.  Targets of a group without matrix, or without means, go.
    """
    n = max_score + 1
    rows = targets.select(group, key, F.col(home).cast("double").alias("_h"), F.col(away).cast("double").alias("_a")).dropna()
    schema = f"`{key}` {targets.schema[key].dataType.simpleString()}, theta_home double, theta_away double"

    def matrix(cells: pd.DataFrame) -> np.ndarray:
        p = np.zeros((n, n))
        p[cells["home_score"], cells["away_score"]] = cells["p"]
        return p

    def tilted(p: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
        t = solve_joint_tilt(p, part["_h"].to_numpy(), part["_a"].to_numpy(), steps, tolerance)
        return pd.DataFrame({key: part[key].to_numpy(), "theta_home": t[:, 0], "theta_away": t[:, 1]})

    if bases.select(group).distinct().count() * n * n * 8 > most_bytes:
        met = lambda _, cells, part: tilted(matrix(cells), part) if len(cells) and len(part) else part[[key]].head(0).assign(theta_home=0.0, theta_away=0.0)
        return bases.groupBy(group).cogroup(rows.groupBy(group)).applyInPandas(met, schema)
    cells = bases.select(group, *CELL, "p").toPandas()
    shared = targets.sparkSession.sparkContext.broadcast({g: matrix(own) for g, own in cells.groupby(group)})

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby(group):
                if g in shared.value:
                    yield tilted(shared.value[g], part)

    return rows.mapInPandas(solved, schema)


def margin_and_total(base: DataFrame, tilted: DataFrame, max_score: int = 100) -> DataFrame:
    """Margin and total distributions of every tilted matrix, without its cells.

    Adds ``margin_from[d + max_score]``, the chance of a margin of d or more, ``total_from[t]``, that of a
    total of t or more (one entry beyond the last), ``draw`` and ``mean_total``.  Whole Arrow
    batches at once, so no fixture's cells are ever rows.
    """
    shared = tilted.sparkSession.sparkContext.broadcast(_grid(base, max_score))
    n = max_score + 1
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tilted.schema)

    def upward(p: np.ndarray) -> list[np.ndarray]:
        sums = np.cumsum(p[:, ::-1], axis=1)[:, ::-1]
        return list(np.concatenate([sums, np.zeros((len(p), 1))], axis=1))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        used_i, used_j = np.flatnonzero(p.sum(axis=1)), np.flatnonzero(p.sum(axis=0))
        for batch in batches:
            eh, ea = batch["theta_home"].to_numpy()[:, None] * used_i, batch["theta_away"].to_numpy()[:, None] * used_j
            eh, ea = np.exp(eh - eh.max(axis=1, keepdims=True)), np.exp(ea - ea.max(axis=1, keepdims=True))
            margins, totals = np.zeros((len(batch), 2 * n - 1)), np.zeros((len(batch), 2 * n - 1))
            for x, i in enumerate(used_i):
                part = eh[:, x : x + 1] * ea * p[i, used_j]
                margins[:, i - used_j + max_score] += part
                totals[:, i + used_j] += part
            mass = totals.sum(axis=1, keepdims=True)
            margins, totals = margins / mass, totals / mass
            yield batch.assign(margin_from=upward(margins), total_from=upward(totals), draw=margins[:, max_score], mean_total=totals @ np.arange(2 * n - 1))

    return tilted.mapInPandas(made, f"{kinds}, margin_from array<double>, total_from array<double>, draw double, mean_total double")
