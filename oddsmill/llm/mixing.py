"""Mixing sources to target weights by entropy balancing.

Every document gets a rate ``w = min(cap, exp(lambda * x))`` with
``x = size / (mean size of its source)``: the exponential tilt of one copy a
document that meets the token target of its source, cut at ``cap`` copies.  The
multipliers solve the convex dual ``sum(size * w) = target``; distributed Newton
steps, kept inside a bracket, are aggregates over the (source, size) histogram.

Rates become whole copies size by size, largest first: each size takes the
whole copies nearest to its tilted share plus what larger sizes left over, so a
source ends within about its smallest document of the target.

Edge cases: a null text has size 0, and rows of size 0 take nothing; a null
source is a source of its own, last in the order; repeated rows are separate
documents; a null ``doc_id`` is named by a hash of the text; sources without words get target 0; if the whole table has no word,
all targets are 0; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise, replaced, row_id, unused

WEIGHTS = (1, 2, 3)
CAP = 3
STEPS = 200  # a bracket that is halved ends well before; a dual that needs more is an error
TOLERANCE = 1e-9
BUCKETS = 64


def word_count() -> Column:
    """The words of ``text``."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: the words of each text."""
    return docs.select(row_id().alias("doc_id"), "source", word_count().alias("size"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights repeat over the sources in code point order.  With a common level
    ``t``, target = min(cap * size, weight * t); the sources that reach their cap
    are those with the smallest size per weight, so one pass over the sources in that
    order (one row a source) finds the level.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("reach", F.col("source_size") * float(cap) / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy())
    by_reach = Window.orderBy("reach", F.col("source").cast("binary"))
    before = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    level = (total - F.coalesce(F.sum(F.col("source_size") * float(cap)).over(before), F.lit(0.0))) / F.sum("weight").over(by_reach.rowsBetween(0, Window.unboundedFollowing))
    # The first source in this order whose cap lies above the level sets it for all that follow.
    rows = rows.withColumn("level", level)
    common = F.min(F.when(F.col("reach") >= F.col("level"), F.struct("reach", "level"))).over(Window.partitionBy())["level"]
    rows = rows.withColumn("common", common)
    target = F.least(F.col("source_size") * float(cap), F.coalesce(F.col("weight") * F.col("common"), F.col("source_size") * float(cap)))
    return rows.select("source", "source_size", target.alias("target"))


def multipliers(hist: DataFrame, goals: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """``source, mean, lam`` by Newton steps on the dual, kept in a bracket.

    ``hist``: source, size (> 0), n.  Sources whose target is their cap need no
    step: their multiplier is infinite and every document is taken ``cap`` times.
    """
    ln_cap = math.log(cap)
    base = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"), F.min("size").alias("least"), F.max("size").alias("most"))
    state = base.join(goals, base["source"].eqNullSafe(goals["source"])).select(
        base["source"], (F.col("words") / F.col("docs")).alias("mean"), "words", "target",
        # exp(high * x) reaches the cap for the smallest document; exp(low * x) is below the tilt for all.
        (F.lit(ln_cap) * F.col("words") / F.col("docs") / F.col("least")).alias("high"),
        (F.least(F.log(F.col("target") / F.col("words")), F.lit(0.0)) * F.col("words") / F.col("docs") / F.col("least") - 1e-9).alias("low"),
        F.lit(0.0).alias("lam"), (F.col("target") >= F.col("words") * cap * (1 - 1e-12)).alias("full"),
    )
    state = moved_from = materialise(state, "mix-state")
    for _ in range(steps):
        rows = hist.join(state, hist["source"].eqNullSafe(state["source"])).drop(hist["source"])
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(ln_cap)))
        grown = F.when(F.col("lam") * x < ln_cap, F.col("size") * F.col("n") * rate * x).otherwise(0.0)
        sums = rows.groupBy(*state.columns).agg(F.sum(F.col("size") * F.col("n") * rate).alias("got"), F.sum(grown).alias("slope"))
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        done = F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        lam = F.when(done, F.col("lam")).when(inside, newton).otherwise((low + high) / 2)
        moved = sums.select("source", "mean", "words", "target", high.alias("high"), low.alias("low"), lam.alias("lam"), "full", (done | F.col("full")).alias("done"))
        moved = replaced(moved, "mix-state", moved_from)
        state, moved_from = moved.drop("done"), moved
        if moved.filter("not done").isEmpty():
            break
    else:
        raise ValueError(f"no solution of the dual after {steps} steps")
    return state.select("source", "mean", "target", "full", "lam")


def _whole_copies(cap: int):
    """Tilted shares of one source as whole copies for each size, largest size first.

    One row for each distinct size, so a group is bounded by the sizes that occur,
    not by the documents of the source.
    """

    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        carry, copies = 0.0, []
        for size, n, rate in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist()):
            carry += size * n * rate
            c = min(cap * n, max(0, int(carry / size + 0.5)))
            carry -= c * size
            copies.append(c)
        return pd.DataFrame({"source": rows["source"], "size": rows["size"], "n": rows["n"], "copies": copies})

    return rounded


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row of ``docs``."""
    all_sizes = materialise(sizes(docs).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")), "mix-sizes")
    hist = materialise(all_sizes.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-hist")
    goals = materialise(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap), "mix-goals")
    coarse = hist.filter("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
    lam = multipliers(coarse, goals, cap, steps)
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("full"), float(cap)).otherwise(F.least(F.exp(F.least(F.col("lam") * x, F.lit(10.0))), F.lit(float(cap))))
    rates = coarse.join(lam, coarse["source"].eqNullSafe(lam["source"])).select(coarse["source"], "size", "n", rate.alias("rate"))
    by_size = rates.groupBy("source").applyInPandas(_whole_copies(cap), "source string, size long, n long, copies long")
    # Within a size the copies are dealt in the order of (bucket, doc_id); buckets split a hot size over tasks.
    same = (hist["source"].eqNullSafe(by_size["source"])) & (hist["size"] == by_size["size"])
    offset = F.sum("bn").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    shares = hist.filter("size > 0").withColumnRenamed("n", "bn").join(by_size.withColumnRenamed("n", "total"), same).select(hist["source"], hist["size"], "bucket", "bn", "total", "copies").withColumn("offset", F.coalesce(offset, F.lit(0)))
    each, extra = F.floor(F.col("copies") / F.col("total")), F.col("copies") % F.col("total")
    shares = shares.select("source", "size", "bucket", each.alias("each"), (extra - F.col("offset")).alias("extra"))
    match = all_sizes["source"].eqNullSafe(shares["source"]) & (all_sizes["size"] == shares["size"]) & (all_sizes["bucket"] == shares["bucket"])
    rows = all_sizes.join(shares, match, "left").select("doc_id", all_sizes["source"], all_sizes["size"], all_sizes["bucket"], "each", "extra")
    nth = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id"))
    rows = rows.withColumn("copies", F.coalesce(F.col("each") + (nth <= F.col("extra")).cast("long"), F.lit(0)).cast("long"))
    return rows.join(goals, rows["source"].eqNullSafe(goals["source"])).select("doc_id", rows["source"], "size", "source_size", "target", "copies")


def repeated_by_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, in all their columns, each as often as the mix takes it.

    A row is found again by ``doc_id``, source and size.  Rows that agree in these are taken
    alike but for one copy more of some; which of them does not matter to the mix, so those
    whose texts have the smaller hashes get it.
    """
    key, origin, words, least, more, nth = (unused(docs, n) for n in ("_id", "_source", "_words", "_least", "_more", "_nth"))
    mixed = mix(docs, weights, cap).groupBy("doc_id", "source", "size", "copies").agg(F.count("*").alias("n"))
    shares = mixed.groupBy(F.col("doc_id").alias(key), F.col("source").alias(origin), F.col("size").alias(words)).agg(F.min("copies").alias(least), F.max(F.struct("copies", "n")).alias(more))
    rows = docs.withColumn(key, row_id()).withColumn(words, word_count())
    both = rows.join(shares, (rows[key] == shares[key]) & rows["source"].eqNullSafe(shares[origin]) & (rows[words] == shares[words]))
    both = both.select(*[rows[c] for c in docs.columns], rows[key], rows[words], least, more)
    own = F.row_number().over(Window.partitionBy(key, "source", words).orderBy(F.xxhash64(F.coalesce("text", F.lit("")))))
    extra = (F.col(more)["copies"] > F.col(least)) & (F.col(nth) <= F.col(more)["n"])
    copies = F.col(least) + F.when(extra, F.col(more)["copies"] - F.col(least)).otherwise(0)
    rows = both.withColumn(nth, own).withColumn(nth, copies).filter(F.col(nth) > 0)
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(nth)))).select(*docs.columns)
