"""Near duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from oddsmill.llm import near_dedup
from oddsmill.llm.components import components
from oddsmill.llm.shingles import shingle_sets


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def near(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, keys string")
    return sorted(tuple(r) for r in near_dedup.near_duplicates(docs, **how).collect())


def corpus(seed, passage=0):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(1, 6)))
    common = [word() for _ in range(passage)]
    rows, k = [(0, None), (1, ""), (2, " \n"), (3, "one Two"), (4, "ONE two"), (5, "one"), (6, "É É"), (7, "é é")], 10
    for _ in range(12):
        base = [word() for _ in range(draw.randint(20, 120))] + common
        for _ in range(draw.randint(1, 6)):
            text = base[:]
            for _ in range(draw.choice([0, 0, 1, 2, 5, 9])):
                text[draw.randrange(len(text))] = word()
            rows.append((k, draw.choice([" ", "\t", " \r\n"]).join(text)))
            k += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("small", "block"), [(64, 50_000), (2, 300)])
def test_equals_all_pairs(spark, small, block):
    rows = corpus(1, 60)
    assert near(spark, rows, small=small, block=block) == brute(rows)


def test_chain_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 100])) for k in range(30)]
    assert near(spark, rows) == brute(rows)
    twice = near(spark, [*rows, rows[3]])
    assert len(twice) == 31 and set(twice) == set(brute(rows))


def test_empty_table(spark):
    assert near(spark, []) == []


def test_shingle_counts():
    for text in ("a b c d e", "a b c d", "x " * 50, "", "q", "A a A a A a A"):
        assert len(shingle_sets([b"pad pad", text.encode(), b"tail"])[1]) == len(shingles(text))
    a, b = shingle_sets([b"One two\x0bthree four FIVE", b"one  two three four five"])
    assert np.array_equal(a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 150: 100}


def test_one_doc_id_on_different_texts(spark):
    words = [f"w{k}" for k in range(80)]
    near_words, other = [*words[:79], "x"], [f"v{k}" for k in range(80)]
    rows = [(1, " ".join(words)), (1, " ".join(other)), (2, " ".join(near_words)), (3, " ".join(other[::-1])), (3, " ".join([*other[:79], "x"])), (4, None), (4, " "), (5, "a b"), (5, "A  b")]
    assert near(spark, rows) == sorted([(1, 76, 1, True), (1, 76, 1, True), (2, 76, 1, False), (3, 76, 3, True), (3, 76, 1, False), (4, 0, 4, True), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True)])
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, own int")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:2].lower().strip()) for r in kept.collect()) == [(1, "v0"), (1, "w0"), (3, "v7"), (4, ""), (4, ""), (5, "a")]
