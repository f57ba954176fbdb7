"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves until the pieces are at most ``leaf`` characters; leaves
are encoded on their own, neighbours are joined up the tree.  A join keeps the
left tokens up to a pre-token border that later text can't move, re-encodes a
window from there over the seam, and doubles the window until one of its
pre-token borders falls on a border of the right part.  From there on the right
tokens stay: the split pattern never looks behind a match's start, so equal
borders mean equal splits, and merges never cross a border.

A match of the split pattern depends on at most ``LOOKAHEAD`` characters after
its end (contractions and the white-space look-ahead), so every left match that
ends that far before the seam is final.

Decoding concatenates the bytes of the tokens up the same tree.

Edge cases: a null text is empty and has no tokens; an empty table gives an empty
result; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import texts

LEAF = 512
WINDOW = 32
LOOKAHEAD = 3
SLICE = 256
_GAP = regex.compile(r"(?<=\S)(?=\s)")


class TreeBpe:
    """Tree encoder for one vocabulary: ranks of byte strings and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.enc = tiktoken.Encoding("tree_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.leaf, self.window = max(leaf, 1), window
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.digits = {i: str(i) for i in ranks.values()}

    def encode(self, text: str) -> list[int]:
        return self._part(text, 0, len(text))

    def _part(self, text: str, start: int, end: int) -> list[int]:
        """Tokens of ``text[start:end]``."""
        if end - start <= self.leaf:
            return self.enc.encode_ordinary(text[start:end])
        mid = (start + end) // 2
        return self._join(text, start, mid, end, self._part(text, start, mid), self._part(text, mid, end))

    def _join(self, text: str, start: int, mid: int, end: int, left: list[int], right: list[int]) -> list[int]:
        drop_from = self._final_border(text, start, mid, left)
        size = self.window
        while True:
            stop = min(end, mid + size)
            # Borders near the end of a cut window may still move.
            matches, meet = self._meeting(text, drop_from, mid, stop, stop if stop == end else stop - LOOKAHEAD)
            if meet is not None or stop == end:
                break
            size *= 2
        if meet is None:
            meet = end
        # Each match on its own: a window cut at ``meet`` would look like the end of the text.
        middle = [i for m in matches for i in self.enc.encode_ordinary(m.group())]
        dropped = self._tokens_of(reversed(left), len(text[drop_from:mid].encode()))
        skipped = self._tokens_of(right, len(text[mid:meet].encode()))
        return left[: len(left) - dropped] + middle + right[skipped:]

    def _meeting(self, text: str, drop_from: int, mid: int, stop: int, sure: int) -> tuple[list, int | None]:
        """Matches from ``drop_from`` up to the first border, at most ``sure``, that the split from ``mid`` has too; and that border.

        Both splits go on in turn and end there, mostly within a few matches.
        """
        own = (m.end() for m in self.split.finditer(text, mid, stop))
        border, matches = mid, []
        for m in self.split.finditer(text, drop_from, stop):
            if m.end() > sure:
                break
            matches.append(m)
            while border is not None and border < m.end():
                border = next(own, None)
            if border == m.end():
                return matches, border
        return matches, None

    def _final_border(self, text: str, start: int, mid: int, left: list[int]) -> int:
        """The last pre-token border of ``text[start:mid]`` that no text after ``mid`` can move.

        Token borders are not all pre-token borders, so candidates come from the
        split itself: it is run from a border found by walking back, doubling the
        stretch until it holds a border that a white-space run surely ends.
        """
        size = self.window
        while True:
            low = max(start, mid - size)
            anchor = low
            if low > start:
                # Before a white space that follows a visible character a match always ends.
                gap = _GAP.search(text, low + 1, mid)
                if gap is None:
                    size *= 2
                    continue
                anchor = gap.start()
            ends = [anchor] + [m.end() for m in self.split.finditer(text, anchor, mid) if m.end() <= mid - LOOKAHEAD]
            if len(ends) > 1 or anchor == start or size >= mid - start:
                return ends[-1]
            size *= 2

    def _tokens_of(self, ids: Iterable[int], n_bytes: int) -> int:
        """How many of the first tokens make up ``n_bytes`` bytes."""
        done = count = 0
        for i in ids:
            if done >= n_bytes:
                break
            done += len(self.bytes_of[i])
            count += 1
        if done != n_bytes:
            raise ValueError("a token crosses a pre-token border")
        return count

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(4)
def tree_bpe(path: str, pattern: str, leaf: int = LEAF) -> TreeBpe:
    """The encoder for a file of base64 byte strings and ranks; kept by each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return TreeBpe(ranks, pattern, leaf)


def encode(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids array<int>`` for every row. ``path`` must be readable on every executor."""

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tree_bpe(path, pattern, leaf)
        for part in parts:
            yield pd.Series([bpe.encode(t) for t in part])

    return texts(docs).select("doc_id", ids("text").alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data binary``: the bytes of ``ids``."""

    @F.pandas_udf("binary")
    def data(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tree_bpe(path, pattern)
        for part in parts:
            yield pd.Series([bpe.decode(list(i)) for i in part])

    return encoded.select("doc_id", data("ids").alias("data"))


def round_trip(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256``: both directions in one pass over the texts."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, pattern, leaf)
        digits = bpe.digits.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(i) for i in ids], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array([t for i in ids for t in i], np.int32)))
                names = [hashlib.sha256(",".join(map(digits, i)).encode()).hexdigest() for i in ids]
                back = [hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]
                columns = [part.column(0), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(names), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(coded, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: both directions in one pass over the texts."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tree_bpe(path, pattern, leaf)
        digits = bpe.digits.__getitem__
        for part in parts:
            rows = []
            for text in part:
                ids = bpe.encode(text)
                rows.append((len(ids), hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).select("doc_id", digests("text").alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
