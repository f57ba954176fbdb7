"""Walk-forward evaluation of blended score distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.rating import binary_loss, clipped
from oddsmill.operators.distributions import log_factorials

#: Blend weights in per cent: steps of five to 90, then 95 and 100.
WEIGHTS = (*range(0, 95, 5), 95, 100)
EVENTS = ("p_score", "p_home", "p_draw", "p_away", "p_over", "p_cover")
METRICS = ("score_loss", "result_loss", "result_brier", "handicap_loss", "total_loss")
#: Cumulative probabilities of a Poisson variable of mean 1.
DRAWS = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518)
#: Modulus of the draws; fifth powers permute the numbers below it.
PRIME = (1 << 31) - 1
ERRORS = ("home_error", "away_error")
#: Weights whose metrics are compared with those of weight 0 by the bootstrap.
COMPARED = (70, 80, 100)


def evaluation_set(rows: DataFrame) -> DataFrame:
    """Numbers or nothing: rows whose scores or expectations are missing, no numbers or negative go."""
    kinds = {"home_score": "int", "away_score": "int", "expected_home": "double", "expected_away": "double"}
    return rows.withColumns({c: F.col(c).cast("string").try_cast(k) for c, k in kinds.items()}).dropna(subset=list(kinds)).filter("least(home_score, away_score, expected_home, expected_away) >= 0")


def joined_evaluation(results: DataFrame, expected: DataFrame, fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Actual and expected scores of fixtures whose teams are known, with both names: the table that ``evaluation_set`` cleans."""
    name = lambda s: teams.select(F.col("team_id").alias(f"{s}_team_id"), F.col("canonical_name").alias(f"{s}_team"))
    rows = fixtures.select("fixture_id", "season", "match_date", "home_team_id", "away_team_id")
    rows = rows.join(results.select("fixture_id", "home_score", "away_score"), "fixture_id").join(expected.select("fixture_id", "expected_home", "expected_away"), "fixture_id")
    return rows.join(name("home"), "home_team_id").join(name("away"), "away_team_id")


def mean_absolute_errors(rows: DataFrame) -> DataFrame:
    h, a, eh, ea = (F.col(c) for c in ("home_score", "away_score", "expected_home", "expected_away"))
    return rows.agg(F.avg(F.abs(h - eh)).alias("home"), F.avg(F.abs(a - ea)).alias("away"), F.avg(F.abs((h - a) - (eh - ea))).alias("margin"), F.avg(F.abs((h + a) - (eh + ea))).alias("total"))


def split_date(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """The first date of the evaluation: one row; dates are few enough to be ordered in one task."""
    dates = rows.select("match_date").distinct()
    place = F.row_number().over(Window.orderBy("match_date")) - 1
    count = F.count("*").over(Window.partitionBy())
    return dates.select("match_date", place.alias("i"), count.alias("n")).filter(F.col("i") == F.floor(F.col("n") * share)).select(F.col("match_date").alias("start"))


def decayed_sums(counts: DataFrame, asked: DataFrame, bins: list[str]) -> DataFrame:
    """``bins, as_of, w, n``: for each asked bin and date the weighted and the plain count of strictly earlier days.

    ``counts``: bins, match_date, n.  ``asked``: bins, as_of.  The weights of ``decay_weight``
    are steps and a tail, so a sum is a difference of running counts at the two edges (730 and
    1,461 days) plus a running sum of counts that double every two years, scaled back.  Asked
    days stand between counted ones in one window a bin: no date meets another, and a bin
    has a row a counted day and three an asked day.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("2000-01-01"))
    doubled = lambda d: F.pow(F.lit(2.0), d / F.lit(730.5))  # noqa: E731  halves every two years of 365.25 days
    d = day("as_of")
    # Day up to which is summed, and the factors of the running count and of the running tail.
    parts = F.array(*[
        F.struct((d - back).alias("day"), F.lit(c).alias("c"), t.alias("t"), F.lit(whole).alias("whole"))
        for back, c, t, whole in ((1, 1.0, F.lit(0.0), 1.0), (731, -0.5, F.lit(0.0), 0.0), (1462, -0.5, 2.0 / doubled(d), 0.0))
    ])
    questions = asked.select(*bins, "as_of", F.explode(parts).alias("q")).select(*bins, "as_of", "q.*", F.lit(0.0).alias("n"), F.lit(0.0).alias("tail"))
    nothing = [F.lit(None).cast("date").alias("as_of"), day("match_date").alias("day"), *[F.lit(0.0).alias(c) for c in ("c", "t", "whole")]]
    events = counts.select(*bins, *nothing, F.col("n").cast("double").alias("n"), (F.col("n") * doubled(day("match_date"))).alias("tail"))
    so_far = Window.partitionBy(*bins).orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.unionByName(questions).select(*bins, "as_of", "c", "t", "whole", F.sum("n").over(so_far).alias("n"), F.sum("tail").over(so_far).alias("tail"))
    return both.filter("as_of IS NOT NULL").groupBy(*bins, "as_of").agg(F.sum(F.col("c") * F.col("n") + F.col("t") * F.col("tail")).alias("w"), F.sum(F.col("whole") * F.col("n")).alias("n"))


def _clipped_history(history: DataFrame, max_score: int) -> DataFrame:
    scores = [F.least(F.col(c), F.lit(max_score)).alias(c) for c in ("home_score", "away_score")]
    return history.dropna(subset=["match_date", "home_score", "away_score"]).groupBy("match_date", *scores).agg(F.count("*").alias("n"))


def walk_forward(history: DataFrame, dates: DataFrame, max_score: int = 80, smoothing: float = 1e-6, least: int = 100) -> DataFrame:
    """``as_of, home_score, away_score, p, elsewhere``: for each date the weighted scorelines of strictly earlier matches.

    There is one matrix a date, not one a fixture.  ``p`` includes the smoothing of the
    cells that occurred before the date; every other cell of the grid has ``elsewhere``.
    Dates with fewer than ``least`` matches before go.
    """
    counts = _clipped_history(history, max_score)
    first = counts.groupBy("home_score", "away_score").agg(F.min("match_date").alias("first"))
    days = dates.agg(F.collect_set("match_date").alias("days"))  # one row
    asked = first.crossJoin(F.broadcast(days)).select("home_score", "away_score", F.explode(F.filter("days", lambda d: d > F.col("first"))).alias("as_of"))
    rows = decayed_sums(counts, asked, ["home_score", "away_score"])
    by_date = Window.partitionBy("as_of")  # at most a grid of cells
    rows = rows.withColumns({"mass": F.sum("w").over(by_date) + (max_score + 1) ** 2 * smoothing, "matches": F.sum("n").over(by_date)}).filter(F.col("matches") >= least)
    return rows.select("as_of", "home_score", "away_score", ((F.col("w") + smoothing) / F.col("mass")).alias("p"), (F.lit(smoothing) / F.col("mass")).alias("elsewhere"))


def history_events(history: DataFrame, asked: DataFrame, prefix: str, max_score: int = 80, smoothing: float = 1e-6, least: int = 100) -> DataFrame:
    """``asked`` with the events of its dates' ``walk_forward`` matrices, whose cells are never made.

    asked: as_of, actual scores ``ah, aa``, and the lines ``total_line, margin_line``.  A match counts in its
    total, its margin, its scoreline and in the sums of scores; three-way, total and margin
    events are sums of one of the first two, read from one row a date.
    """
    n = max_score + 1
    counts = _clipped_history(history, max_score)
    h, a = F.col("home_score"), F.col("away_score")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), b.cast("int").alias("bin"), v.alias("v")) for k, b, v in (
        ("total", h + a, F.lit(1)), ("margin", h - a, F.lit(1)), ("cell", h * n + a, F.lit(1)), ("home", F.lit(0), h), ("away", F.lit(0), a),
    )])
    binned = counts.select("match_date", "n", F.explode(kinds).alias("x")).groupBy("x.kind", "x.bin", "match_date").agg(F.sum(F.col("n") * F.col("x.v")).alias("n"))
    days = asked.select("as_of").distinct()
    spans = {"total": (0, 2 * max_score), "margin": (-max_score, max_score), "home": (0, 0), "away": (0, 0)}
    dense = F.array(*[F.struct(F.lit(k).alias("kind"), F.sequence(F.lit(low), F.lit(high)).alias("bins")) for k, (low, high) in spans.items()])
    wide = days.select("as_of", F.explode(dense).alias("x")).select("x.kind", F.explode("x.bins").alias("bin"), "as_of")
    cell = (F.least("ah", F.lit(max_score)) * n + F.least("aa", F.lit(max_score))).cast("int")
    cells = asked.select(F.lit("cell").alias("kind"), cell.alias("bin"), "as_of").distinct()
    sums = decayed_sums(binned, wide.unionByName(cells), ["kind", "bin"])
    upward = Window.partitionBy("as_of", "kind").orderBy(F.desc("bin"))  # at most 2 max_score + 1 rows
    whole = Window.partitionBy("as_of", "kind")
    ranked = sums.filter("kind <> 'cell'").select("as_of", "kind", "bin", F.sum("w").over(upward).alias("w"), F.sum("n").over(whole).alias("n"))
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("bin", "w")))), lambda x: x["w"])
    tables = ranked.groupBy("as_of").agg(of("total").alias("_total"), of("margin").alias("_margin"), F.max(F.when(F.col("kind") == "home", F.col("w"))).alias("_home"), F.max(F.when(F.col("kind") == "away", F.col("w"))).alias("_away"), F.max(F.when(F.col("kind") == "total", F.col("n"))).alias("_matches"))
    mass = F.col("_total")[0]
    tables = tables.filter(F.col("_matches") >= least).withColumn("_mass", mass + n * n * smoothing)
    hits = sums.filter("kind = 'cell'").select("as_of", F.col("bin").alias("_cell"), F.col("w").alias("_hit"))
    # The arrays of a date, one row each, come last: no row is shuffled with them.
    rows = asked.withColumn("_cell", cell).join(hits, ["as_of", "_cell"]).join(F.broadcast(tables), "as_of")

    def above(c: str, line: Column, low: int, high: int) -> Column:
        at = F.floor(line).cast("int") + 1 - low  # the first value above the line, as a place in the array
        return F.when(at <= 0, F.col(c)[0]).when(at > high - low, 0.0).otherwise(F.get(c, F.least(F.greatest(at, F.lit(0)), F.lit(high - low))))

    total = above("_total", F.col("total_line"), 0, 2 * max_score)
    margin = lambda line: above("_margin", line, -max_score, max_score)
    found = {"p_score": F.col("_hit"), "p_home": margin(F.lit(0.0)), "p_draw": margin(F.lit(-1.0)) - margin(F.lit(0.0)), "p_away": F.col("_margin")[0] - margin(F.lit(-1.0)), "p_over": total, "p_cover": margin(F.col("margin_line")), "home_mean": F.col("_home"), "away_mean": F.col("_away")}
    out = rows.select(*asked.columns, *[(x / F.col("_mass")).alias(f"{prefix}_{c}") for c, x in found.items()], (F.lit(smoothing) / F.col("_mass")).alias("elsewhere"))
    return with_floor(out, prefix, max_score)


def poisson_events(rows: DataFrame, home: str, away: str, prefix: str, max_score: int = 80) -> DataFrame:
    """``rows`` with the events of independent Poisson scores, the mass beyond ``max_score`` folded into it.

    A side's chances are one array; whatever compares the two is a product of one array with
    running sums of the other, so a fixture's cells are never made.  A missing or negative
    mean gives no events.
    """
    names = [*EVENTS, "home_mean", "away_mean"]
    logs = np.array(log_factorials(max_score))

    def folded(mean: np.ndarray) -> np.ndarray:
        k = np.arange(max_score + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.exp(k * np.log(mean)[:, None] - mean[:, None] - logs)
        p[mean == 0] = k == 0
        p[:, -1] = 1 - p[:, :-1].sum(axis=1)
        return p

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def events(eh: pd.Series, ea: pd.Series, ah: pd.Series, aa: pd.Series, total: pd.Series, margin: pd.Series) -> pd.DataFrame:
        means = [np.where(x.to_numpy(float) >= 0, x.to_numpy(float), np.nan) for x in (eh, ea)]
        h, a = folded(means[0]), folded(means[1])
        k, row = np.arange(max_score + 1), np.arange(len(h))[:, None]
        below = np.concatenate([np.zeros((len(a), 1)), np.cumsum(a, axis=1)], axis=1)  # below[j]: the chance of fewer than j
        fewer = lambda at: below[row, np.clip(at, 0, max_score + 1).astype(int)]
        whole = below[:, -1:]
        hs, as_ = (np.minimum(x.to_numpy(float), max_score) for x in (ah, aa))
        at = lambda p, x: np.where(np.isnan(x), np.nan, p[row[:, 0], np.nan_to_num(x).astype(int)])
        out = {
            "p_score": at(h, hs) * at(a, as_), "p_home": (h * below[:, :-1]).sum(axis=1), "p_draw": (h * a).sum(axis=1), "p_away": (h * (whole - below[:, 1:])).sum(axis=1),
            "p_over": (h * (whole - fewer(np.floor(total.to_numpy(float))[:, None] - k + 1))).sum(axis=1), "p_cover": (h * fewer(k - np.floor(margin.to_numpy(float))[:, None])).sum(axis=1),
            "home_mean": (h * k).sum(axis=1), "away_mean": (a * k).sum(axis=1),
        }
        return pd.DataFrame({c: pd.Series(v).where(~np.isnan(v), None) for c, v in out.items()}, columns=names)

    made = rows.withColumn("_e", events(F.col(home), F.col(away), "ah", "aa", "total_line", "margin_line"))
    return made.select(*rows.columns, *[F.col(f"_e.{c}").alias(f"{prefix}_{c}") for c in names])


def with_floor(rows: DataFrame, prefix: str, max_score: int = 80) -> DataFrame:
    """``events`` of smoothed matrices: the cells that do not occur have ``elsewhere`` each.

    The cells of the grid that an event holds are counted by formula, so that they need no rows.
    """
    n = max_score + 1
    total, margin = (F.floor(F.col(c)).cast("int") + 1 for c in ("total_line", "margin_line"))
    over = F.when(total <= 0, n * n).when(total <= max_score, n * n - total * (total + 1) / 2).when(total <= 2 * max_score, (2 * n - 1 - total) * (2 * n - total) / 2).otherwise(0)
    cover = F.when(margin > max_score, 0).when(margin >= 1, (n - margin) * (n + 1 - margin) / 2).when(margin > -max_score, n * n - (max_score + margin) * (n + margin) / 2).otherwise(n * n)
    held = {"p_score": 1, "p_home": n * max_score / 2, "p_draw": n, "p_away": n * max_score / 2, "p_over": over, "p_cover": cover}
    held |= {f"{s}_mean": n * n * max_score / 2 for s in ("home", "away")}
    return rows.withColumns({f"{prefix}_{c}": F.col(f"{prefix}_{c}") + F.col("elsewhere") * k for c, k in held.items()}).drop("elsewhere")


def sweep(rows: DataFrame, a: str, b: str, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Events of every blend of models a and b: blends are linear, so six numbers a model are enough."""
    out = rows.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    part = F.col("weight") / 100.0
    return out.withColumns({n: F.col(f"{a}_{n}") * (1 - part) + F.col(f"{b}_{n}") * part for n in (*EVENTS, "home_mean", "away_mean")}).drop(*[f"{m}_{n}" for m in (a, b) for n in (*EVENTS, "home_mean", "away_mean")])


def losses(rows: DataFrame) -> DataFrame:
    """Log losses, Brier score and errors of the means; rows have the events, ``ah, aa`` and the lines."""
    h, a = F.col("ah"), F.col("aa")
    p = F.when(h > a, F.col("p_home")).when(h == a, F.col("p_draw")).otherwise(F.col("p_away"))
    brier = sum(F.pow(F.col(c) - F.when(hit, 1.0).otherwise(0.0), F.lit(2)) for c, hit in (("p_home", h > a), ("p_draw", h == a), ("p_away", h < a)))
    return rows.withColumns({
        "score_loss": -F.log(clipped(F.col("p_score"))), "result_loss": -F.log(clipped(p)), "result_brier": brier,
        "handicap_loss": binary_loss(F.col("p_cover"), h - a > F.col("margin_line")), "total_loss": binary_loss(F.col("p_over"), h + a > F.col("total_line")),
        "home_error": F.abs(F.col("home_mean") - h), "away_error": F.abs(F.col("away_mean") - a),
    })


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.countDistinct("fixture_id").alias("fixtures"), *[F.avg(m).alias(m) for m in (*METRICS, *ERRORS)])


def swept_summary(rows: DataFrame, a: str, b: str, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``summary`` by weight of the blends that ``sweep`` makes of ``rows``.

    Every weight has the fixtures of ``rows``, so they are counted there: nothing is shuffled a fixture and weight.
    """
    fixtures = rows.agg(F.countDistinct("fixture_id").alias("fixtures"))  # one row
    means = losses(sweep(rows, a, b, weights)).groupBy("weight").agg(*[F.avg(m).alias(m) for m in (*METRICS, *ERRORS)])
    return means.crossJoin(F.broadcast(fixtures)).select("weight", "fixtures", *METRICS, *ERRORS)


def best(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The weight with the least mean of each metric, the smaller weight of equals."""
    long = table.select(*(by or []), "weight", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value")) for m in (*METRICS, *ERRORS)])).alias("x"))
    return long.groupBy(*(by or []), F.col("x.metric").alias("metric")).agg(F.min(F.struct(F.col("x.value"), F.col("weight"))).alias("b")).select(*(by or []), "metric", "b.weight", "b.value")


def draw_seeds(fixture: Column, seed: int) -> list[Column]:
    """Two numbers below ``PRIME`` for a fixture, from a digest of its id."""
    digest = F.md5(F.concat_ws("|", fixture.cast("string"), F.lit(str(seed))).cast("binary"))
    return [F.pmod(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long"), F.lit(PRIME)) for k in range(2)]


def draw_counts(first: np.ndarray, second: np.ndarray, samples: int) -> np.ndarray:
    """How often each fixture stands in samples 1 to ``samples``: Poisson(1) counts from a permutation polynomial modulo ``PRIME``."""
    x = (first[:, None] + np.arange(1, samples + 1) * second[:, None]) % PRIME
    square = x * x % PRIME
    x = square * square % PRIME * x % PRIME
    return np.searchsorted(DRAWS, x / float(PRIME), side="right")


def bootstrap(rows: DataFrame, metrics: tuple[str, ...] = METRICS, weights: tuple[int, ...] = COMPARED, base: int = 0, samples: int = 2000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of the differences of metrics between weights and the base weight.

    A fixture stands in each sample as often as a Poisson(1) draw by hash says, the same for
    all differences.  A task adds its fixtures to one matrix of samples by differences and
    hands on that alone; matrices are added up by groups of tasks and then to one.
    """
    at = lambda w, m: F.max(F.when(F.col("weight") == w, F.col(m)))
    names = {f"d_{m}_{w}": (w, m) for w in weights for m in metrics}
    width = len(names) + 1  # the last column counts the draws
    pairs = rows.filter(F.col("weight").isin(*weights, base)).groupBy("fixture_id").agg(*[(at(w, m) - at(base, m)).alias(c) for c, (w, m) in names.items()])
    seeded = pairs.dropna().select(*[s.alias(f"s{k}") for k, s in enumerate(draw_seeds(F.col("fixture_id"), seed))], *names)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((samples, width))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                counts = draw_counts(part["s0"].to_numpy(), part["s1"].to_numpy(), samples).astype(float)
                total += counts.T @ np.column_stack([part[list(names)].to_numpy(float), np.ones(len(part))])
        yield pd.DataFrame({"m": [total.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(samples * width)
        for batch in batches:
            for m in batch["m"]:
                total += np.frombuffer(m)
        yield pd.DataFrame({"m": [total.tobytes()]})

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in batch["m"]:
                total = np.frombuffer(m).reshape(samples, width)
                total = total[total[:, -1] > 0]
                yield pd.DataFrame(total[:, :-1] / total[:, -1:], columns=list(names))

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    sums = seeded.mapInPandas(drawn, "m binary").repartition(max(1, round(tasks**0.5))).mapInPandas(added, "m binary")
    by_sample = sums.repartition(1).mapInPandas(added, "m binary").mapInPandas(means, ", ".join(f"{c} double" for c in names))  # a row a sample
    long = by_sample.select(F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(m).alias("metric"), F.col(c).alias("m")) for c, (w, m) in names.items()])).alias("x")).select("x.*")
    return long.groupBy("weight", "metric").agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") < 0).cast("double")).alias("share_better"))


def model_comparison(rows: DataFrame) -> DataFrame:
    """One row a fixture and model: chance of the actual score, three-way prices, implied means.

    ``rows`` as ``sweep`` takes them, with events of the models ``poisson`` and ``hist``; the blend is at 20 per cent.
    """
    from oddsmill.functions.rating import price

    table = sweep(rows, "poisson", "hist", (0, 20, 100))
    name = F.when(F.col("weight") == 0, "poisson").when(F.col("weight") == 100, "history").otherwise("blend")
    return table.select("fixture_id", name.alias("model"), "p_score", *[price(F.col(f"p_{s}")).alias(f"price_{s}") for s in ("home", "draw", "away")], "home_mean", "away_mean")
