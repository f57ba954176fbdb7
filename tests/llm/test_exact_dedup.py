"""Exact deduplication against grouping by the normalised text."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from oddsmill.llm import exact_dedup


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def rows_of(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, keep_id int, chunk string")
    return sorted(tuple(r) for r in exact_dedup.exact_duplicates(docs, **how).collect())


CASES = [(1, None), (2, ""), (3, " "), (4, "\t\n "), (5, "a b"), (6, "a  b"), (7, "a b"), (8, "a\tb"), (9, "x" * 1000), (10, "x" * 999 + "y"), (11, "x" * 1000), (12, " a b"), (12, " a b")]


def test_small_cases(spark):
    assert rows_of(spark, CASES) == brute(CASES)


@pytest.mark.parametrize("moduli", [(7, 5), (2, 3)])
def test_collisions_are_told_apart(spark, moduli):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices("ab ", k=4))) for i in range(60)] + [(100, None)]
    assert rows_of(spark, rows, moduli=moduli, chunk=3) == brute(rows)


def test_chunks_compose():
    data = bytes(range(256)) * 3
    m = exact_dedup.MODULI[0]
    whole = exact_dedup.chunk_hash(data, m)
    left, right = data[:100], data[100:]
    assert whole == (exact_dedup.chunk_hash(left, m) * pow(exact_dedup.BASE, len(right), m) + exact_dedup.chunk_hash(right, m)) % m


def test_huge_documents_take_the_dealt_path(spark):
    docs = spark.createDataFrame([(1, "ab" * 400), (2, "ab" * 400), (3, "c")], "doc_id long, text string")
    small = {r.doc_id: (r.f1, r.f2) for r in exact_dedup.fingerprints(docs, chunk=64).collect()}
    dealt = {r.doc_id: (r.f1, r.f2) for r in exact_dedup.fingerprints(docs, chunk=64, huge=10).collect()}
    assert small == dealt and small[1] == small[2] != small[3]


def test_empty_table(spark):
    assert rows_of(spark, []) == []


SHARED_IDS = [(1, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "a"), (4, "x y"), (4, "x  y"), (5, None), (5, "b"), (2, "b")]


def test_one_doc_id_on_different_texts(spark):
    assert rows_of(spark, SHARED_IDS) == brute(SHARED_IDS)


def test_one_row_of_each_text_stays_under_shared_ids(spark):
    docs = spark.createDataFrame([(i, t, {"k": n}) for n, (i, t) in enumerate(SHARED_IDS)], "doc_id long, text string, own map<string,int>")
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in kept.collect()]
    assert sorted(got) == [(1, "a"), (1, "b"), (3, "c"), (4, "x y"), (5, "")]
