"""The classifier on planted noise, its solver against the dual's conditions, and edge cases."""

import random

import numpy as np
import pytest

from oddsmill.llm import quality

WORDS = ["the", "tide", "runs", "over", "grey", "stones", "and", "gulls", "turn", "slowly"]


def corpus(n=160):
    draw = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randint(10, 60))]
        bad = k % 4 == 0
        text = " ".join(w.upper() + "!!" if k % 8 else w + "***" for w in words) if bad else " ".join(words).capitalize() + "."
        rows.append((k, text, "q", 1))
        labels.append((k, int(not bad), 0))
    return rows, labels


def tables(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, y int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_noise(spark):
    rows, labels = corpus()
    docs, known = tables(spark, [*rows, (900, None, "q", 1), (901, "", "q", 1), (5, rows[5][1], "q", 1)], labels)
    got = quality.classify(docs, known).collect()
    assert len(got) == len(rows) + 3
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    assert len({r.score for r in got if r.doc_id == 5}) == 1


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 0.99), ([(1, None, 0)], 0.5)])
def test_nothing_to_learn(spark, labels, want):
    docs, known = tables(spark, [(1, "a", "", 1), (2, None, "", 1)], labels)
    assert [r.score for r in quality.classify(docs, known).collect()] == pytest.approx([want, want])


def test_empty_table(spark):
    docs, known = tables(spark, [], [])
    assert quality.classify(docs, known).collect() == []


def test_solver_meets_the_optimality_conditions():
    draw = np.random.default_rng(0)
    rows = [np.sort(draw.choice(30, 8, replace=False)) for _ in range(60)]
    values = [v / np.linalg.norm(v) for v in draw.normal(size=(60, 8))]
    labels = np.where(draw.random(60) < 0.5, 1.0, -1.0)
    w = quality.dual_coordinate_descent(rows, values, labels, 30, cost=1.0, passes=400)

    def loss(u):
        return u @ u / 2 + sum(max(0.0, 1 - y * float(u[x] @ v)) for x, v, y in zip(rows, values, labels, strict=True))

    best = loss(w)
    assert all(best <= loss(w + d) + 1e-6 for d in draw.normal(size=(200, 30)) * 0.01)


def test_features_are_distinct_and_of_the_text_alone():
    alone = quality.features([b"one two two"])[0]
    among = quality.features([b"x y", b"one two two", b""])
    assert len(set(alone.tolist())) == len(alone)
    assert set(among[1].tolist()) == set(alone.tolist()) and len(among[2]) == 0
