"""Fill-in-the-middle: a document's prefix, suffix and middle, cut at token ends and rearranged.

Cuts are drawn in tokens (a run of visible characters with the white space before it;
white space at the end is one more) and given in code points, as everything that Spark
counts in strings; texts are cut in bytes.  A sparse index of a batch converts the two:
it holds the places of the multibyte characters and the excess bytes up to each, and a
binary search among them is all that a cut costs.  Where a text has none, as in ASCII
spans, code points and bytes differ by a constant.

White space is ASCII and no byte of a multibyte character is, so tokens are found in the
bytes of the whole batch at once.

Edge cases: a null text is empty, has no tokens and stays plain; a text of white space is
one token; repeated rows are cut alike; a row without ``doc_id`` is named by a hash of its
text; texts that hold a sentinel stay plain; other columns are ignored; an empty table
stays empty.  Very long texts are handled whole, a batch slice of their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import texts
from oddsmill.llm.token_files import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE = 50  # per cent of the documents that are rearranged
SPM = 80  # per cent of those that begin with the suffix
SEED = 42
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SparseIndex:
    """Converts cuts between code points and bytes in the texts of a batch.

    ``at``: byte places of the multibyte characters, over the whole batch; ``excess``: bytes
    beyond one a character, up to and including each of them.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.points = self.at - np.concatenate([[0], self.excess[:-1]]) if len(self.at) else self.at
        self.begins = begins
        self.first = self._points(begins)

    def _before(self, found: np.ndarray) -> np.ndarray:
        return np.where(found > 0, self.excess[np.maximum(found, 1) - 1], 0) if len(self.at) else np.zeros(len(found), np.int64)

    def _points(self, places: np.ndarray) -> np.ndarray:
        return places - self._before(np.searchsorted(self.at, places))

    def to_points(self, places: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Byte places in the batch, at characters' beginnings, as code points within the text of each."""
        return self._points(places) - self.first[text]

    def to_bytes(self, points: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Code points within each text as byte places in the batch."""
        points = points + self.first[text]
        return points + self._before(np.searchsorted(self.points, points))


def token_ends(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where tokens end, over the whole batch, and how many of them lie before each text and after the last."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(ends) + 1, np.int64)
    visible = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    stop = np.zeros(len(data) + 1, bool)
    stop[1:-1] = visible[:-1] & ~visible[1:]
    stop[ends] = True  # what a text ends with, visible or not, is or ends a token
    stop[0] = False
    places = np.flatnonzero(stop)
    return places, np.searchsorted(places, np.concatenate([[0], ends]), "right")


def _draws(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _rearranged(batch: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    text = batch.column(1)
    text = text if isinstance(text, pa.StringArray) else text.cast(pa.string())
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    begins, ends, own = offsets[:-1], offsets[1:], np.arange(len(text))
    index = SparseIndex(data, begins)
    places, upto = token_ends(data, ends)
    h = [np.asarray(batch.column(2 + k)) for k in range(4)]
    # An empty text ends where the one before does; that place is no token of its own.
    n = np.where(ends > begins, upto[1:] - upto[:-1], 0)
    one, two = h[0] % (n + 1), h[1] % (n + 1)

    def cut(units: np.ndarray) -> np.ndarray:
        found = places[np.maximum(upto[:-1] + units - 1, 0)] if len(places) else begins
        return index.to_points(np.where(units > 0, found, begins), own)

    prefix, middle = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    a, b = index.to_bytes(prefix, own).tolist(), index.to_bytes(middle, own).tolist()
    whole, forms, outputs = memoryview(np.ascontiguousarray(data)), [], []
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    drawn, first = (h[2] % 100 < rate).tolist(), (h[3] % 100 < spm).tolist()
    for k, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        body = bytes(whole[begin:end])
        if not (body and drawn[k]) or p in body or s in body or m in body:
            forms.append("plain")
            outputs.append(body)
            continue
        x, y, z = body[: a[k] - begin], body[b[k] - begin :], body[a[k] - begin : b[k] - begin]
        forms.append("spm" if first[k] else "psm")
        outputs.append(b"".join([s, y, p, x, m, z] if first[k] else [p, x, s, y, m, z]))
    plain = np.array([f == "plain" for f in forms])
    counts = [pa.array(c, pa.int64(), mask=plain) for c in (prefix, middle - prefix)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(forms), *counts, pa.array(outputs, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def rearranged(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """``doc_id``, tokens ``n``, ``form`` (plain, psm, spm), code points of prefix and middle, and the ``output`` text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield _rearranged(part, rate, spm)

    return texts(docs).select("doc_id", "text", *_draws(seed)).mapInArrow(made, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A rearranged text holds each sentinel once, as no text with one is rearranged."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    pieces = lambda at: F.concat(*[F.element_at(parts, k + 1) for k in at])
    return F.when(form == "psm", pieces((1, 3, 2))).when(form == "spm", pieces((2, 3, 1))).otherwise(output)
