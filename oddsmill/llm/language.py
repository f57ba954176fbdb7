"""Language identification by prediction by partial matching.

For each language a byte context tree of order 3 is counted on a bounded sample of
labelled texts.  Under the frozen counts a byte costs ``-log2(n / (total + kinds))``
in the longest context that has seen it; every longer context that has not costs
its escape ``-log2(kinds / (total + kinds))`` first, and below order 0 a byte costs
8 bits.  The language with the shortest code of the whole text is predicted; the
score is its posterior under equal priors.

The sample: at most about ``most`` documents a language (a bound on fitting alone;
every text is scored whole).  The distinct four-byte strings of the sample, whose
number that bounds, are the model, and are broadcast.

Edge cases: ``und`` with score 0 for a text that is null or has no letter; with no
language to learn from every text is ``und``; repeated rows are scored alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise, maybe_in

ORDER = 3
MOST = 1500
SLICE = 1 << 20


def held_out(folds: int, fold: int) -> Column:
    """Whether the row is kept from learning, by the CRC of its ``doc_id``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def codes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, itself and the three before it as one number; and where each part starts."""
    lead = b"\0" * ORDER
    data = np.frombuffer(b"".join(lead + p for p in parts), np.uint8).astype(np.uint32)
    out = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    keep = np.ones(len(out), bool)
    for k in range(ORDER):  # the bytes of the next part's lead are no text
        gaps = starts[1:] - ORDER + k
        keep[gaps] = False
    return out[keep], np.concatenate([[0], np.cumsum(lengths)])


class ContextTree:
    """Frozen byte statistics of one language for all orders up to ``ORDER``."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER, -1, -1):
            keys, at = np.unique(strings & np.uint32((1 << (8 * (order + 1))) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(keys))
            contexts, own = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(own, n, len(contexts)), np.bincount(own, minlength=len(contexts))
            self.levels.append((order, keys, -np.log2(n / (total + kinds)[own]), contexts, -np.log2(kinds / (total + kinds))))

    def bits(self, strings: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string after the bytes before it."""
        out = np.zeros(len(strings))
        open_ = np.arange(len(strings))
        for order, keys, cost, contexts, escape in self.levels:
            own = strings[open_] & np.uint32((1 << (8 * (order + 1))) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = keys[at] == own
            out[open_[seen]] += cost[at[seen]]
            open_, own = open_[~seen], own[~seen] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            known = contexts[at] == own
            out[open_[known]] += escape[at[known]]
        out[open_] += 8.0
        return out


def sample(docs: DataFrame, most: int = MOST) -> DataFrame:
    """At most about ``most`` rows (doc_id, lang) of each language, chosen by the hash of ``doc_id``."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    sizes = materialise(labelled.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(sizes, "lang").filter(draw * F.col("n") <= most).select("doc_id", "lang").distinct()


def fit(docs: DataFrame, most: int = MOST) -> dict[str, ContextTree]:
    """Context trees of the languages in ``docs`` (doc_id, text, lang)."""
    chosen = materialise(sample(docs, most), "language-sample")
    rows = maybe_in(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").alias("own")), chosen.select("doc_id"))
    rows = rows.join(chosen, "doc_id").filter("own = lang").select("lang", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                strings, n = np.unique(codes([t.encode() for t in texts])[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "string": strings.astype(np.int64), "n": n})

    counts = rows.mapInPandas(counted, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n")).toPandas()
    return {lang: ContextTree(g["string"].to_numpy().astype(np.uint32), g["n"].to_numpy().astype(float)) for lang, g in sorted(counts.groupby("lang"))}


def predict(docs: DataFrame, trees: dict[str, ContextTree]) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    names = list(trees)
    model = docs.sparkSession.sparkContext.broadcast(list(trees.values()))

    def scored(parts: list[bytes]) -> tuple[list[str], list[float]]:
        strings, bounds = codes(parts)
        if not len(strings):
            return [], []
        kinds, at = np.unique(strings, return_inverse=True)
        totals = []
        for tree in model.value:
            sums = np.concatenate([[0.0], np.cumsum(tree.bits(kinds)[at])])
            totals.append(sums[bounds[1:]] - sums[bounds[:-1]])
        bits = np.array(totals)
        best = bits.argmin(axis=0)
        odds = np.exp2(np.maximum(bits.min(axis=0) - bits, -1000.0)).sum(axis=0)
        return [names[k] for k in best], (1.0 / odds).tolist()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, scores = [], [], []
            parts, where, size = [], [], 0

            def flush() -> None:
                for k, lang, score in zip(where, *scored(parts), strict=True):
                    langs[k], scores[k] = lang, score

            for i, text, letters in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                langs.append("und")
                scores.append(0.0)
                if letters and names:
                    parts.append(text.as_py().encode())
                    where.append(len(ids) - 1)
                    size += len(parts[-1])
                    if size > SLICE:
                        flush()
                        parts, where, size = [], [], 0
            if parts:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, most: int = MOST, folds: int = 3, fold: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn from all folds but one, predict every row."""
    trees = fit(docs.filter(~held_out(folds, fold)), most)
    return predict(docs, trees).select("doc_id", held_out(folds, fold).alias("held_out"), "lang_pred", "score")
