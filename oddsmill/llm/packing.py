"""Packing of tokenised documents into windows by Karmarkar-Karp differencing.

A task streams its documents.  Of each document every whole window of ids becomes a
sequence of its own at once; what is left (fewer ids than a window) waits.  When
enough leftovers wait, they are cut into pieces and dealt to windows by multiway
differencing: the two partial partitions with the greatest imbalance are merged, the
fullest window of one with the emptiest of the other, until one partition is left.
Its windows are nearly equal.  The count of windows starts at the least that can hold
all ids and rises whenever a window exceeds its capacity.

Cuts come in ``LEVELS``.  First one leftover in four is cut into its powers of two and
one in four into halves, quarters and so on: small change, by which the last merges even
out the windows; the others stay whole.  Where a window exceeds its capacity even so
(many leftovers of one awkward length), all leftovers are cut into powers of two, and
only then the count of windows rises.

No row is shuffled, and a task holds leftovers of ``GROUP_IDS`` ids at most, so memory
does not depend on the table, on a key or on the longest text.  A sequence's
number is made of the number of its task's partition and a count within it; a task that
runs again reads the same rows in the same order and makes the same sequences.

Edge cases: a null text is empty and holds the end id alone; repeated rows are packed
one by one; a row without ``doc_id`` is named by a hash of its text; other columns are
ignored; an empty table has no pieces.  Very long texts become whole windows, encoded in
slices of bounded size.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from oddsmill.llm.common import texts
from oddsmill.llm.token_files import slices, unit_encoder

WINDOW = 1024
GROUP_IDS = 1 << 18  # ids of leftovers that are packed together
GROUP = 4096  # leftovers that are packed together at most
LEVELS = (4, 1)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of every piece: the largest differencing method for ``windows`` parts.

    A partial partition is its window loads in falling order less the least of them.  Merges
    are kept as the order that sorted their sums, and resolved from the last one down.
    """
    count = len(sizes)
    if windows == 1:
        return np.zeros(count, np.int64)
    # Heap entries: imbalance, negated; node; nodes below ``count`` are single pieces.
    heap = [(-int(s), k) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    loads: dict[int, np.ndarray] = {}
    merged: list[tuple[int, int, np.ndarray]] = []

    def taken(size: int, node: int) -> np.ndarray:
        if node >= count:
            return loads.pop(node)
        load = np.zeros(windows, np.int64)
        load[0] = size
        return load

    while len(heap) > 1:
        (s, a), (t, b) = heapq.heappop(heap), heap[0]
        total = taken(-s, a) + taken(-t, b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        node = count + len(merged)
        loads[node] = total
        merged.append((a, b, order.astype(np.int32)))
        heapq.heapreplace(heap, (-int(total[0]), node))
    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(windows)}
    out = np.zeros(count, np.int64)
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        before = np.empty(windows, np.int64)
        before[order] = places.pop(count + k)
        for node, place in ((a, before), (b, before[::-1])):
            if node < count:
                out[node] = place[0]
            else:
                places[node] = place
    return out


def powers(n: int) -> list[int]:
    """``n`` as a sum of different powers of two, in falling order."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def halves(n: int) -> list[int]:
    """``n`` as a half, a quarter and so on."""
    out = []
    while n > 1:
        out.append(n // 2)
        n -= n // 2
    return [*out, n]


def pieces_of(lengths: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of the pieces: of every ``level`` leftovers one is cut into powers of two, the next into halves."""
    owner, start, length = [], [], []
    for k, n in enumerate(lengths.tolist()):
        parts = powers(n) if k % level == 0 else halves(n) if k % level == 1 else [n]
        at = 0
        for p in parts:
            owner.append(k)
            start.append(at)
            length.append(p)
            at += p
    return np.array(owner, np.int64), np.array(start, np.int64), np.array(length, np.int64)


def packed(lengths: np.ndarray, window: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start, length and window of the pieces of leftovers (each from 1 to ``window`` ids)."""
    count = -(-int(lengths.sum()) // window)
    for level in levels:
        owner, start, length = pieces_of(lengths, level)
        places = differencing(length, count)
        if np.bincount(places, length, count).max() <= window:
            return owner, start, length, places
    while np.bincount(places, length, count).max() > window:
        count += 1
        places = differencing(length, count)
    return owner, start, length, places


class Packer:
    """Packs the documents of one task as they come; every method gives finished pieces as a record batch."""

    def __init__(self, first: int, window: int = WINDOW, group: int = GROUP, group_ids: int = GROUP_IDS):
        self.window, self.group, self.group_ids = window, group, group_ids
        self.next = first
        self.waiting: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.held = 0

    def add(self, doc_ids: list[int | None], values: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole, begin = [], 0
        for doc_id, end in zip(doc_ids, ends.tolist(), strict=True):
            n = end - begin
            cut = n - n % self.window
            for at in range(0, cut, self.window):
                whole.append((doc_id, at, self.window, n, self.next, 0, values[begin + at : begin + at + self.window]))
                self.next += 1
            if cut < n:
                # A copy, so that the ids of the batch are not kept with it.
                self.waiting.append((doc_id, cut, n, values[begin + cut : end].copy()))
                self.held += n - cut
                if self.held >= self.group_ids or len(self.waiting) >= self.group:
                    yield from self.flush()
            begin = end
        if whole:
            yield _batch(whole)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.waiting:
            return
        owner, start, length, window = packed(np.array([len(w[3]) for w in self.waiting]), self.window)
        order = np.lexsort((start, owner, window))
        rows, offset, last = [], 0, -1
        for k, s, n, w in zip(owner[order].tolist(), start[order].tolist(), length[order].tolist(), window[order].tolist(), strict=True):
            offset = offset if w == last else 0
            doc_id, cut, tokens, ids = self.waiting[k]
            rows.append((doc_id, cut + s, n, tokens, self.next + w, offset, ids[s : s + n]))
            offset, last = offset + n, w
        self.next += int(window.max()) + 1
        self.waiting, self.held = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    *plain, ids = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32, copy=False)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in plain), lists], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def sequences(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents with their ids: rows of ``SCHEMA``.

    ``start``: ids of the document before the piece; ``offset``: ids of the sequence before
    it; ``doc_tokens``: ids of the document, its ``end_id`` included.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        for batch in batches:
            for part in slices(batch, 1):
                yield from packer.add(part.column(0).to_pylist(), *encoder.encode(part.column(1), end_id))
        yield from packer.flush()

    return texts(docs).mapInArrow(made, SCHEMA)


def with_crc32(rows: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` with ``ids_crc32``, the digest of the ids as little-endian 32-bit integers, in place of ``ids``."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(6)
            ends, data = np.asarray(ids.offsets).tolist(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(crc, pa.int64())], [*batch.schema.names[:6], "ids_crc32"])

    return rows.mapInArrow(digests, SCHEMA.replace("ids array<int>", "ids_crc32 long"))
