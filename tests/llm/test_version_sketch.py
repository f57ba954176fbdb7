"""Sketches against the digest sets themselves, and the edited texts against Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from oddsmill.llm import version_sketch as vs


def true_likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_decoded_likeness_is_exact(spark):
    draw = random.Random(6)
    rows = []
    for k in range(40):
        base = [draw.getrandbits(63) - (1 << 62) for _ in range(draw.choice([0, 1, 5, 40, 90, 300]))]
        other = base[: int(len(base) * draw.choice([1, 0.9, 0.7]))] + [draw.getrandbits(60) for _ in range(draw.choice([0, 0, 3, 20]))]
        rows.append((k, base, other))
    frame = spark.createDataFrame(rows, "k long, a array<long>, b array<long>")
    got = {r.k: r for r in vs.compared(frame).collect()}
    for k, a, b in rows:
        want = true_likeness(a, b)
        assert got[k].likeness == pytest.approx(want, abs=1e-12)
        assert sorted(got[k].likeness_digests.a) == sorted(set(a) - set(b)) and sorted(got[k].likeness_digests.b) == sorted(set(b) - set(a))
        assert (a == b) <= (got[k].sketch_a == got[k].sketch_b)


def test_peel_reports_failure(spark):
    few, many = list(range(3)), list(range(1000, 1400))
    frame = spark.createDataFrame([(1, few), (2, many)], "k int, a array<long>")
    hashed = frame.select("k", F.transform("a", lambda x: F.xxhash64(x)).alias("a"))
    cells = vs.subtract(vs.sketch(F.col("a"), F.lit(8)), vs.sketch(F.array().cast("array<bigint>"), F.lit(8)))
    got = {r.k: r for r in hashed.select("k", "a", vs.peel(cells, F.lit(8)).alias("d")).collect()}
    assert got[1].d.all and sorted(got[1].d.a) == sorted(got[1].a) and not got[1].d.b
    assert not got[2].d.all


def test_larger_sketches_recover_from_a_guess_that_is_far_too_low(spark):
    draw = random.Random(12)
    a = [draw.getrandbits(64) - (1 << 63) for _ in range(500)] + [-(1 << 63), (1 << 63) - 1, 0, -1]
    b = [*a[:100], -(1 << 63), 1]
    frame = spark.createDataFrame([(1, a, b), (2, b, a), (3, a, []), (4, [], []), (5, a, a)], "k int, a array<long>, b array<long>")
    for guess in (0, 10_000):
        for r in frame.select("a", "b", vs.differing(F.col("a"), F.col("b"), F.lit(guess)).alias("d")).collect():
            assert sorted(r.d.a) == sorted(set(r.a) - set(r.b)) and sorted(r.d.b) == sorted(set(r.b) - set(r.a))


def cut(text):
    """The paragraphs of a text."""
    return re.findall(vs.PARAGRAPH, text)


def test_versions(spark):
    draw = random.Random(3)
    line = lambda: "".join(draw.choices("abc déf", k=30)) + draw.choice([".", "\n", "! "])
    rows = [(k * 3, "".join(line() for _ in range(draw.randint(0, 40))), "c") for k in range(25)] + [(100, None, "c"), (101, "", "c"), (102, "same. same. " * 40, "c"), (103, "same. same. " * 40, "c"), (3, None, "c")]
    rows[-1] = (3, rows[1][1], "c")  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, edited string")
    got = vs.versions(docs).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    ids = sorted(text)
    by_print = {}
    for r in got:
        t, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(true_likeness(cut(t), cut(edited)), abs=1e-9)
        assert r.near_next == pytest.approx(true_likeness(cut(t), cut(after)), abs=1e-9)
        if t == after:
            assert r.near_next == 1
        by_print.setdefault(t, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_print.values())
    long = [r for r in got if len(text[r.doc_id]) > 600 and r.doc_id < 100]
    assert all(r.near_edited > r.near_next for r in long)


def test_one_document_and_empty_table(spark):
    one = vs.versions(spark.createDataFrame([(7, "only. this one. here")], "doc_id long, text string")).collect()
    assert [r.near_next for r in one] == [1.0]
    assert vs.versions(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_native_plan(spark):
    docs = spark.createDataFrame([(7, "only.")], "doc_id long, text string")
    plan = vs.versions(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_a_row_without_doc_id_and_a_long_text(spark):
    text = "".join(f"Paragraph number {k} of a long text.\n" for k in range(20_000))
    rows = vs.versions(spark.createDataFrame([(None, "no id. at all."), (1, text), (2, text[: len(text) // 2])], "doc_id long, text string")).collect()
    got = {r.n_chars: r for r in rows}
    assert len(rows) == 3 and got[len(text)].near_next == pytest.approx(true_likeness(cut(text), cut(text[: len(text) // 2])), abs=1e-9)
