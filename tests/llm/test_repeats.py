"""Repeated byte strings against counting every window."""

import random
from collections import Counter

import numpy as np
import pytest

from oddsmill.llm import repeats


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s : s + length] for _, d in texts for s in range(len(d) - length + 1))
    out = []
    for i, d in texts:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return sorted(out)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, s int, e int")
    return sorted((*tuple(r)[:4], bytes(r.kept)) for r in repeats.without_repeats(docs, **how).collect())


def corpus(seed, n=60, alphabet="abcdé "):
    draw = random.Random(seed)
    text = lambda k: "".join(draw.choices(alphabet, k=k))
    passages = [text(draw.randint(15, 90)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 300), (4, "ab" * 200 + "c"), (5, "abcabc" * 9), (6, "a" * 20)]
    for k in range(10, 10 + n):
        parts = [text(draw.randint(0, 60)) for _ in range(draw.randint(1, 4))]
        parts.insert(draw.randrange(len(parts) + 1), draw.choice(passages) * draw.choice([1, 1, 2]))
        rows.append((k, "".join(parts)))
    rows += [(900, rows[20][1]), (901, rows[20][1][:-3] + "zzz"), (902, rows[20][1])]
    return rows


@pytest.mark.parametrize(("length", "gram", "hot", "block"), [(20, 6, 8192, 1 << 20), (20, 6, 3, 200), (12, 12, 8192, 500), (25, 4, 40, 1 << 20)])
def test_equals_counting_windows(spark, length, gram, hot, block):
    rows = corpus(length + hot)
    assert found(spark, rows, length=length, gram=gram, hot=hot, block=block) == brute(rows, length)


def test_production_length(spark):
    draw = random.Random(9)
    words = lambda k: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(k))
    passage = words(60)
    rows = [(k, words(40) + " " + passage + " " + words(30)) for k in range(8)] + [(50, "x" * 70_000), (51, words(20_000)), (52, passage[:199]), (53, passage[:200]), (53, passage[:200])]
    assert found(spark, rows) == brute(rows, 200)


@pytest.mark.parametrize("seed", range(5))
def test_index_matches(seed):
    draw = random.Random(seed)
    strings = ["".join(draw.choices("ab", k=draw.randint(1, 40))).encode() for _ in range(30)] + [b"a" * 50, b"abab" * 10, bytes(20)]
    index = repeats.RunIndex(strings)
    suffixes = sorted((s[k:], j, k) for j, s in enumerate(strings) for k in range(len(s)))
    best = {}
    for (x, *a), (y, *b) in zip(suffixes, suffixes[1:], strict=False):
        common = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        for at in (a, b):
            best[tuple(at)] = max(best.get(tuple(at), 0), common)
    got = index.matches()
    for j, s in enumerate(strings):
        assert got[index.bounds[j] : index.bounds[j + 1]].tolist() == [best[j, k] for k in range(len(s))]
    assert index.runs < len(index.data)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_a_hot_passage_is_split_by_longer_anchors(spark):
    draw = random.Random(31)
    text = lambda k: "".join(draw.choices("abcdefgh ", k=k))
    passage, copy = text(90), text(300)
    rows = [(k, text(50) + passage + text(50)) for k in range(40)] + [(100 + k, copy) for k in range(30)]
    rows += [(200 + k, copy[: 20 * k + 5] + "#" + copy[20 * k + 6 :]) for k in range(14)] + [(300 + k, "ab" * (40 + k)) for k in range(9)]
    assert found(spark, rows, length=30, gram=6, hot=4, block=500) == brute(rows, 30)


def test_one_doc_id_on_different_texts(spark):
    draw = random.Random(5)
    text = lambda k: "".join(draw.choices("abcdefgh ", k=k))
    passage = text(60)
    rows = [(1, passage + text(300)), (1, text(350)), (2, text(20) + passage), (3, text(90)), (3, None), (3, text(90))]
    rows.append((3, rows[3][1]))
    assert found(spark, rows, length=30, gram=6) == brute(rows, 30)
