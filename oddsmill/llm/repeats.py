"""Removal of long repeated byte strings with a run-length index.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere
else in the corpus, the same document included; matches never cross documents.

1. Every window of ``length`` bytes is named by its anchor, the leftmost of its
   q-grams with the least hash.  Equal windows have equal anchors, so only windows
   whose anchor hash occurs again can be repeats.  Consecutive windows of one
   anchor make one segment.
2. Segments that share an anchor hash meet in one group, with their text.  Complete
   groups are packed into blocks; equal segments are counted once.  Over the distinct
   segments of a block a run-length Burrows-Wheeler index is built: a suffix order,
   the runs of its preceding bytes, and at both ends of every run a sample of the
   longest match with the neighbour.  Matching statistics are streamed from those
   samples alone: inside a run a suffix matches one byte less than its left
   neighbour in the text.  Windows that match ``length`` bytes or more are marked.
3. A group of more than ``hot`` segments is never held in one task.  Its segments are
   named by a 128-bit digest and counted, on the map side first.  A segment that occurs
   again goes whole; one of each kind stays in the group.  If more than ``hot`` kinds
   are left, each is cut anew at longer anchors, so that windows which share less
   part, until every part fits into the index.  The last anchor is the whole window.
4. Marked ranges meet their document again and are cut out.

Edge cases: a null text is empty; texts shorter than ``length`` bytes keep all of
them; repeated rows are occurrences of their own, and so are rows of one ``doc_id`` with
different texts; a null ``doc_id`` is named by a hash of the text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import clashing, materialise, maybe_in, tasks, texts, told_apart
from oddsmill.llm.shingles import mix

LENGTH = 200
GRAM = 32
HOT = 8192
SLICE = 1 << 19
BLOCK = 2 << 20
PIECE = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACES = 20  # bits of a place within a slice


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Anchors:
    """Segments of windows that share an anchor, over slices of at most ``2**20`` bytes."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, min(gram, length)
        self.width = length - self.gram + 1
        self.up = _powers(_BASE, 1 << _PLACES)
        self.down = _powers(pow(_BASE, -1, 1 << 64), 1 << _PLACES)

    def segments(self, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Part number, start within it, windows, anchor hash and anchors of each segment."""
        lengths = np.array([len(p) for p in parts])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = len(data)
        if n < self.length:
            return (np.zeros(0, np.int64),) * 5
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        m = n - self.gram + 1
        grams = mix((sums[self.gram :] - sums[:m]) * self.down[:m])
        # The place in the low bits makes the least key the leftmost of equal hashes.
        keys = (grams & ~np.uint64((1 << _PLACES) - 1)) | np.arange(m, dtype=np.uint64)
        w = self.width
        padded = np.full(-(-m // w) * w, np.uint64(2**64 - 1))
        padded[:m] = keys
        rows = padded.reshape(-1, w)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - w + 1
        place = (np.minimum(after[:windows], before[w - 1 : w - 1 + windows]) & np.uint64((1 << _PLACES) - 1)).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), lengths)[:windows]
        valid = np.arange(windows) + self.length <= bounds[part + 1]
        new = np.ones(windows, bool)
        new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        at = np.flatnonzero(new & valid)
        ends = np.append(np.flatnonzero(new | ~valid), windows)
        size = ends[np.searchsorted(ends, at, side="right")] - at
        hashes, owner = grams[place[at]], part[at]
        # Neighbouring anchors of one hash (periodic text) make one segment of several anchors.
        joint = np.ones(len(at), bool)
        joint[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + size[:-1])
        first = np.flatnonzero(joint)
        if not len(first):
            return (np.zeros(0, np.int64),) * 5
        return owner[first], at[first] - bounds[owner[first]], np.add.reduceat(size, first), hashes[first].view(np.int64), np.diff(np.append(first, len(at)))

    def rows(self, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        """``h, doc_id, span, anchors`` of the segments of parts (doc_id, start in the document, bytes)."""
        owner, start, windows, h, count = self.segments([data for _, _, data in parts])
        ids, offsets = (np.array([p[k] for p in parts], np.int64) for k in (0, 1))
        span = (start + offsets[owner]) * 65536 + windows if len(owner) else start
        doc = ids[owner] if len(owner) else start
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (h, doc, span, count)], ["h", "doc_id", "span", "anchors"])


def anchored(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``h, doc_id, span, anchors`` of every segment; ``span`` is start * 65536 + windows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)

        step = 32768  # windows of a part, so that their number fits into span
        for batch in batches:
            parts, size = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode()
                for a in range(0, max(0, len(data) - length + 1), step):
                    part = data[a : a + step + length - 1]
                    if size + len(part) > SLICE:
                        yield anchors.rows(parts)
                        parts, size = [], 0
                    parts.append((i, a, part))
                    size += len(part)
            if parts:
                yield anchors.rows(parts)

    return docs.mapInArrow(found, "h long, doc_id long, span long, anchors long")


class RunIndex:
    """Run-length Burrows-Wheeler index over a few strings, with samples at the ends of runs."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings])
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.owner = np.repeat(np.arange(len(strings)), lengths)
        self.left = self.bounds[self.owner + 1] - np.arange(len(self.data))  # bytes to the end of the string
        self.words = self._packed()
        self.order = self._sorted(len(strings))
        self._sample()

    def _packed(self) -> np.ndarray:
        """Eight bytes from every place, zero beyond the string."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        out = np.zeros(len(self.data), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | padded[k : k + len(out)]
        short = np.flatnonzero(self.left < 8)
        out[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - self.left[short]).astype(np.uint64))) - np.uint64(1))
        return out

    def _sorted(self, strings: int) -> np.ndarray:
        """Places in suffix order by prefix doubling; every string ends in a terminator of its own."""
        n = len(self.data)
        # Zero bytes look like the end of a string, so there the length decides too.
        head = np.minimum(self.left, 8) if (self.data == 0).any() else np.zeros(n, np.int64)
        order = np.lexsort((head, self.words)) if head.any() else np.argsort(self.words)
        fresh = np.ones(n, bool)
        words, head = self.words[order], head[order]
        fresh[1:] = (words[1:] != words[:-1]) | (head[1:] != head[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        step = 8
        while True:
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                return order
            places = order[slots]
            beyond = self.left[places] <= step
            second = np.where(beyond, self.owner[places], strings + rank[np.where(beyond, 0, places + step)])
            key = rank[places] * (n + strings + 1) + second
            by = np.argsort(key)
            places, key = places[by], key[by]
            order[slots] = places
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            fresh[slots] = new
            rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            step *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, within their strings."""
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            at = out[live]
            x = self.words[a[live] + at] ^ self.words[b[live] + at]
            same = x == 0
            # Leading equal bytes of eight.
            lead = np.where(same, 8, 0)
            for k in range(1, 8):
                lead = np.where(~same & (x >> np.uint64(64 - 8 * k) == 0), k, lead)
            out[live] = at + lead
            live = live[same & (out[live] < most[live])]
        return np.minimum(out, most)

    def _sample(self) -> None:
        """Matches with the neighbours in suffix order, computed where a run of preceding bytes begins or ends."""
        n, order = len(self.data), self.order
        starts = self.left[order] == np.diff(self.bounds)[self.owner[order]]  # no byte precedes
        before = self.data[order - 1].astype(np.int64)
        before[starts] = -1
        edge = (before[1:] != before[:-1]) | starts[1:] | starts[:-1]
        self.runs = int(edge.sum()) + 1
        k = np.flatnonzero(edge)
        common = self._common(order[k], order[k + 1])
        self.up = np.full(n, -1, np.int64)  # with the suffix before, at heads of runs
        self.down = np.full(n, -1, np.int64)  # with the suffix after, at ends of runs
        self.up[order[k + 1]] = common
        self.down[order[k]] = common
        self.up[order[0]] = self.down[order[-1]] = 0

    def matches(self) -> np.ndarray:
        """For each place, the longest match that starts there and at any other place."""
        place = np.arange(len(self.data))
        best = np.zeros(len(self.data), np.int64)
        for samples in (self.up, self.down):
            last = np.maximum.accumulate(np.where(samples >= 0, place, 0))
            best = np.maximum(best, samples[last] - (place - last))
        return best


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def marked_block(groups: list[dict[bytes, list[tuple[int, int]]]], length: int) -> list[tuple[int, int, int]]:
    """``doc_id, start, end`` of repeated bytes in complete groups: text of a segment -> its (doc_id, start)."""
    out, strings, where = [], [], []
    for group in groups:
        for text, at in group.items():
            if len(at) > 1:
                out += [(i, s, s + len(text)) for i, s in at]
        if len(group) > 1 or any(len(at) == 1 for at in group.values()):
            for text, at in group.items():
                strings.append(text)
                where.append(at)
    if strings:
        index = RunIndex(strings)
        long = index.matches() >= length
        for k in np.unique(index.owner[long]).tolist():
            if len(where[k]) == 1:
                i, s = where[k][0]
                out += [(i, s + a, s + b + length - 1) for a, b in _runs(long[index.bounds[k] : index.bounds[k + 1]])]
    return out


def _pieces(span: int) -> Iterator[tuple[int, int]]:
    start, windows = divmod(span, 65536)
    for a in range(0, windows, PIECE):
        yield start + a, min(PIECE, windows - a)


def _with_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text`` and the list of the document's spans, bounded by its length."""
    lists = materialise(spans.groupBy("doc_id").agg(F.collect_set(F.struct("span", "h")).alias("spans")), "span-lists")
    return maybe_in(docs, lists.select("doc_id")).join(lists, "doc_id").select("doc_id", "text", "spans.span", "spans.h")


def _marked(docs: DataFrame, spans: DataFrame, length: int, block: int, parts: int) -> DataFrame:
    """Ranges found by the index in the groups of ``spans`` (h, doc_id, span)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, hs, strings, size = [], [], [], [], 0
            for i, text, spans, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode()
                for span, h in zip(spans.values.to_pylist(), keys.values.to_pylist(), strict=True):
                    for s, n in _pieces(span):
                        ids.append(i)
                        starts.append(s)
                        hs.append(h)
                        strings.append(data[s : s + n + length - 1])
                        size += len(strings[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(strings, pa.binary())], ["h", "doc_id", "start", "data"])
                    ids, starts, hs, strings, size = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(strings, pa.binary())], ["h", "doc_id", "start", "data"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict[bytes, list[tuple[int, int]]]] = []
        last, size = None, 0

        def out() -> pa.RecordBatch:
            rows = marked_block(groups, length)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], ["doc_id", "s", "e"])

        for batch in batches:
            for h, i, s, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if h != last:
                    if size > block:
                        yield out()
                        groups, size = [], 0
                    groups.append({})
                    last = h
                at = groups[-1].setdefault(data, [])
                if not at:
                    size += len(data)
                at.append((i, s))
        if groups:
            yield out()

    segments = _with_text(docs, spans).mapInArrow(cut, "h long, doc_id long, start long, data binary")
    return segments.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(search, "doc_id long, s long, e long")


def _grams(length: int, gram: int) -> Iterator[int]:
    """Ever longer anchors after ``gram``; the last is a whole window."""
    while gram < length:
        rest = (length - gram) // 3
        gram = length - rest if rest >= 4 else length
        yield gram


def _named(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """``h, d1, d2, doc_id, span``: the segments with a digest of their text."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, spans, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode()
                at = spans.values.to_pylist()
                names = [hashlib.blake2b(data[s // 65536 : s // 65536 + s % 65536 + length - 1], digest_size=16).digest() for s in at]
                two = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array([i] * len(at), pa.int64()), spans.values], ["h", "d1", "d2", "doc_id", "span"])

    return _with_text(docs, spans).mapInArrow(named, "h long, d1 long, d2 long, doc_id long, span long")


def _anchored_again(docs: DataFrame, spans: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of longer anchors within those of ``spans``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            parts, size = [], 0
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                for start, windows in (divmod(s, 65536) for s in spans.values.to_pylist()):
                    part = data[start : start + windows + length - 1]
                    if size + len(part) > SLICE:
                        yield anchors.rows(parts)
                        parts, size = [], 0
                    parts.append((i, start, part))
                    size += len(part)
            if parts:
                yield anchors.rows(parts)

    return _with_text(docs, spans).mapInArrow(found, "h long, doc_id long, span long, anchors long")


def _grouped(rows: DataFrame, hot: int) -> DataFrame:
    """``h, doc_id, span, hot``: the segments (h, doc_id, span, anchors) whose anchor hash occurs again."""
    shared = materialise(rows.groupBy("h").agg(F.sum("anchors").alias("c")).filter("c > 1"), "shared-anchors")
    return materialise(rows.select("h", "doc_id", "span").join(shared, "h").select("h", "doc_id", "span", (F.col("c") > hot).alias("hot")), "shared-spans")


def _split(docs: DataFrame, spans: DataFrame, length: int, gram: int, hot: int, block: int, parts: int) -> DataFrame:
    """Ranges found in the hot groups of ``spans`` (h, doc_id, span)."""
    grams, ranges, key = _grams(length, gram), None, ["h", "d1", "d2"]
    while True:
        segments = materialise(_named(docs, spans, length), "hot-segments")
        kinds = segments.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "span")).alias("one"))
        kinds = materialise(kinds.select(*key, "n", "one.doc_id", "one.span"), "hot-kinds")
        again = segments.join(kinds.filter("n > 1").select(*key), key, "left_semi")
        start = F.floor(F.col("span") / 65536)
        found = again.select("doc_id", start.alias("s"), (start + F.col("span") % 65536 + length - 1).alias("e"))
        gram = next(grams, None)
        many = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
        placed = materialise(kinds.join(many, "h").select("h", "doc_id", "span", (F.col("kinds") > (hot if gram else 1 << 62)).alias("hot")), "hot-groups")
        found = found.unionByName(_marked(docs, placed.filter("not hot"), length, block, parts))
        left = placed.filter("hot")
        if not left.isEmpty():
            placed = _grouped(materialise(_anchored_again(docs, left, length, gram), "anchors"), hot)
            found = found.unionByName(_marked(docs, placed.filter("not hot"), length, block, parts))
            left = placed.filter("hot")
        found = materialise(found, "hot-ranges")
        ranges = found if ranges is None else ranges.unionByName(found)
        if left.isEmpty():
            return ranges
        spans = left.select("h", "doc_id", "span")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``doc_id, s, e``: byte ranges of ``docs`` (doc_id, text) that are repeats; ranges may overlap."""
    parts = tasks(docs.sparkSession)
    spans = _grouped(materialise(anchored(docs, length, gram), "anchors"), hot)
    ranges = _marked(docs, spans.filter("not hot"), length, block, parts)
    crowded = spans.filter("hot").select("h", "doc_id", "span")
    if not crowded.isEmpty():
        ranges = ranges.unionByName(_split(docs, crowded, length, min(gram, length), hot, block, parts))
    return ranges


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row of ``docs``."""
    rows = texts(docs)
    twice = clashing(rows, "text")
    docs = rows.withColumn("own", F.col("doc_id")) if twice.isEmpty() else told_apart(rows, twice).select("doc_id", "text", "own")
    ranges = materialise(repeated_ranges(docs.select("doc_id", "text"), length, gram, hot, block), "ranges")
    lists = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    both = docs.join(lists, "doc_id", "left").select("own", "text", "ranges.s", "ranges.e")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for i, text, s, e in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                    data = text.encode()
                    kept, n_spans, done, reach = [], 0, 0, -1
                    for a, b in sorted(zip(s.values.to_pylist(), e.values.to_pylist(), strict=True)) if s.is_valid else ():
                        if a > reach:
                            n_spans += 1
                            kept.append(data[done:a])
                        reach = max(reach, b)
                        done = reach
                    left = b"".join([*kept, data[done:]])
                    rows.append((i, len(data), len(data) - len(left), n_spans, left))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
