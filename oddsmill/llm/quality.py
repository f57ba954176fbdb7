"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: byte 3-grams of the text, and 1- to
3-grams of word shapes (case, digits, symbols, repetition of the word before).  Each
indicator is scaled by its class log-count ratio
``r = log((a + p) / (a*d + |p|)) - log((a + n) / (a*d + |n|))`` and texts are scaled to unit
length.  A linear hinge-loss model is fitted by dual coordinate descent in blocks of the
training rows, whose weights are averaged; a logistic curve through the margins of
rows from other blocks makes scores between 0 and 1.

The classifier is fitted on at most about ``most`` labelled documents (a bound on
fitting alone); every text is scored whole.  Counts, blocks and margins are Spark
aggregates; the model is two arrays of ``2**DIMENSIONS`` numbers.

Edge cases: a null text is empty; empty texts get the score of a zero margin; with
no labelled rows, or rows of one class only, every score is the share of label 1 (0.5
without rows); if a document has several labels the lowest counts; repeated rows are
scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise, maybe_in, texts
from oddsmill.llm.language import held_out
from oddsmill.llm.shingles import mix, word_hashes

DIMENSIONS = 18
MOST = 12_000
BLOCKS = 6
PASSES = 12
COST = 1.0
SMOOTH = 1.0
THRESHOLD = 0.3
SLICE = 256
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LOWER = np.isin(np.arange(256), list(range(97, 123)) + list(range(128, 256)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))


def _word_shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and shape of each word: which kinds of characters it has, and its last byte if a symbol."""
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def has(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        return np.minimum(sums[ends] - sums[starts], 2)

    last = data[ends - 1]
    symbol = np.where(_UPPER[last] | _LOWER[last] | _DIGIT[last], 0, last.astype(np.int64))
    return starts, has(_UPPER) + 3 * has(_LOWER) + 9 * has(_DIGIT) + 27 * symbol


def features(parts: list[bytes], dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """The distinct feature numbers of each text."""
    lengths = np.array([len(p) + 1 for p in parts])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    shift = np.uint64(64 - dimensions)

    def hashed(values: np.ndarray, kind: int) -> np.ndarray:
        return (mix(values.astype(np.uint64) * np.uint64(16) + np.uint64(kind)) >> shift).astype(np.int64)

    wide = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
    grams = hashed((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:], 3)
    words, _ = word_hashes(parts)
    starts, shapes = _word_shapes(data)
    shapes = shapes * 2
    shapes[1:] += words[1:] == words[:-1]
    pad = np.concatenate([shapes, np.zeros(2, np.int64)])
    shape_grams = [hashed(shapes, 4), hashed((pad[:-2] << 16) | pad[1:-1], 5), hashed((pad[:-2] << 32) | (pad[1:-1] << 16) | pad[2:], 6)]
    at = np.searchsorted(starts, bounds)
    seen = np.zeros(1 << dimensions, np.int32)
    out = []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        w0, w1 = at[k], at[k + 1]
        own = np.concatenate([grams[a : max(a, b - 3)], *(g[w0 : max(w0, w1 - j)] for j, g in enumerate(shape_grams))])
        order = np.arange(len(own), dtype=np.int32)
        seen[own] = order
        out.append(own[seen[own] == order])
    return out


class Model(NamedTuple):
    weights: np.ndarray  # of an indicator, its log-count ratio included
    squares: np.ndarray  # of the log-count ratios, for the length of a text
    slope: float
    offset: float

    def margins(self, rows: list[np.ndarray]) -> list[float]:
        return [float(self.weights[r].sum() / math.sqrt(max(self.squares[r].sum(), 1e-12))) if len(r) else 0.0 for r in rows]

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.asarray(margins) + self.offset, -500, 500)))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = COST, passes: int = PASSES, seed: int = 3) -> np.ndarray:
    """Weights that minimise ``|w|^2 / 2 + cost * sum(max(0, 1 - y w.x))``; rows have unit length."""
    w, alpha, draw = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(passes):
        for k in draw.permutation(len(rows)):
            x, v, y = rows[k], values[k], labels[k]
            gradient = y * float(w[x] @ v) - 1.0
            new = min(max(alpha[k] - gradient, 0.0), cost)
            if new != alpha[k]:
                w[x] += (new - alpha[k]) * y * v
                alpha[k] = new
    return w


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), with smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (goal - p))
        beta = beta + step
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _featured(rows: DataFrame) -> DataFrame:
    """Rows (text, ...) with ``x``, their features, in place of the text."""
    rest = [c for c in rows.columns if c != "text"]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = features([t.encode() for t in part.column(len(rest)).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(f) for f in found], dtype=np.int32)), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), lists], [*rest, "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.select(*rest, "text").mapInArrow(featured, f"{kinds}, x array<int>")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, blocks: int = BLOCKS) -> Model:
    """``labels``: doc_id, quality (0 or 1). Only documents that it has are learnt from."""
    size = 1 << DIMENSIONS
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"))
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = materialise(known.filter(draw * total <= most), "quality-sample")
    rows = maybe_in(texts(docs), chosen.select("doc_id")).join(chosen, "doc_id").dropDuplicates(["doc_id"])
    rows = rows.select(F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "text")
    rows = materialise(_featured(rows), "quality-rows")
    classes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        share = 0.5 if not classes else min(max(float(next(iter(classes))), 0.01), 0.99)
        return Model(np.zeros(size), np.zeros(size), 0.0, math.log(share / (1 - share)))
    counts = rows.select("y", F.explode("x").alias("x")).groupBy("x").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).toPandas()
    p, n = np.full(size, SMOOTH), np.full(size, SMOOTH)
    p[counts["x"]] += counts["p"]
    n[counts["x"]] += counts["n"]
    ratio = np.log(p / p.sum()) - np.log(n / n.sum())
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def scaled(x: np.ndarray) -> np.ndarray:
        v = shared.value[x]
        return v / math.sqrt(max(float(v @ v), 1e-12))

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.asarray(x, np.int64) for x in pdf["x"]]
        w = dual_coordinate_descent(own, [scaled(x) for x in own], np.where(pdf["y"] == 1, 1.0, -1.0), size)
        at = np.flatnonzero(w)
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "x": at, "w": w[at]})

    fitted = rows.groupBy("block").applyInPandas(one_block, "block int, x long, w double").toPandas()
    parts = {b: np.bincount(g["x"], g["w"], size) for b, g in fitted.groupby("block")}
    every = sum(parts.values())
    others = {b: (every - w) / max(1, len(parts) - 1) if len(parts) > 1 else w for b, w in parts.items()}
    held = docs.sparkSession.sparkContext.broadcast(others)

    @F.pandas_udf("double")
    def margin(block: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([float(held.value[b][i] @ scaled(i)) if len(i) else 0.0 for b, i in zip(block, map(lambda i: np.asarray(i, np.int64), x), strict=True)], dtype="float64")

    curve = rows.select("y", margin("block", "x").alias("m")).toPandas()
    slope, offset = _logistic(curve["m"].to_numpy(), curve["y"].to_numpy())
    return Model(every / len(parts) * ratio, ratio**2, slope, offset)


def scores_of(model: Model, spark: SparkSession):
    """A column function: the score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(part: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(part), SLICE):
            margins = shared.value.margins(features([t.encode() for t in part.iloc[at : at + SLICE]]))
            out.append(shared.value.scores(np.array(margins)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return lambda text: scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", scores_of(model, docs.sparkSession)(F.col("text")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learn from all folds but one, score every row."""
    model = fit(docs, labels.select("doc_id", "quality").filter(~held_out(folds, fold)), most)
    return score(docs, model).select("doc_id", held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
