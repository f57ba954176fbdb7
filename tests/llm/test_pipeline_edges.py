"""Every stage on nulls, empty texts, repeated rows, clashing columns and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oddsmill.llm.common import materialise

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, nth int, copies int, _bucket int, _bitmap string, _id int, h long, shares map<string,int>"
TAIL = (77, 9, 5, "b", 3, 4, {"k": 1})
LONG = " ".join(f"word{k}" for k in range(30_000))


def row(doc_id, text, source="s", n=1):
    return (doc_id, text, "en", source, n, *TAIL)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([(k, k % 2, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def ran(spark, folder, name, rows):
    docs = materialise(spark.createDataFrame(rows, SCHEMA), "edges")
    found = STAGES[name](spark, docs, folder)
    assert found.columns == docs.columns
    return sorted(found.collect(), key=str)


ROWS = [
    row(1, "one two three four five six"), row(1, "one two three four five six"), row(2, "one  two three four five six"),
    row(3, None, None), row(4, "", None), row(None, "seven eight nine ten eleven"), row(None, "seven eight nine ten eleven"), row(None, "seven eight nine"),
    row(7, LONG, "t"), row(8, LONG + " tail", "t"), row(9, None, None, None),
]


def test_exact_stage(spark, folder):
    got = ran(spark, folder, "exact dedup", ROWS)
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, ROWS[0][1]), (3, None), (None, "seven eight nine ten eleven"), (None, "seven eight nine"), (7, LONG), (8, LONG + " tail")])
    assert all(tuple(r)[5:] == TAIL for r in got)


def test_near_stage(spark, folder):
    got = ran(spark, folder, "minhash near-dedup", ROWS)
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, ROWS[0][1]), (3, None), (4, ""), (9, None), (None, "seven eight nine ten eleven"), (None, "seven eight nine"), (7, LONG)])
    assert all(tuple(r)[5:] == TAIL for r in got)


def test_mixing_stage_takes_rows_and_not_doc_ids(spark, folder):
    got = ran(spark, folder, "mixing to target weights", [row(5, "a b c", "s"), row(5, "a b c", "s"), row(6, "a b c", "s"), row(None, "d e f", "s"), row(7, "", "s"), row(8, None, None)])
    # One source with words: every document of its size is taken once.
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(5, "a b c"): 2, (6, "a b c"): 1, (None, "d e f"): 1})
    assert all(tuple(r)[5:] == TAIL for r in got)


def test_mixing_stage_keeps_the_shares_of_repeated_rows(spark, folder):
    rows = [row(k % 4, "w " * (k + 1), f"s{k % 3}") for k in range(12)]
    got = ran(spark, folder, "mixing to target weights", rows)
    total = sum(k + 1 for k in range(12))
    taken = Counter()
    for r in got:
        taken[r.source] += len(r.text.split())
    for k, weight in enumerate((1, 2, 3)):
        assert abs(taken[f"s{k}"] - total * weight / 6) <= 3
    assert max(Counter((r.doc_id, r.text) for r in got).values()) <= 3


@pytest.mark.parametrize("order", [1, -1])
def test_mixing_stage_takes_the_row_of_the_size(spark, folder, order):
    rows = [row(5, ""), row(5, "a b c d"), row(6, "x y"), row(5, "p q r s t"), row(5, None)]
    got = ran(spark, folder, "mixing to target weights", rows[::order])
    # One source: every text with words is taken once, those without never.
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(5, "a b c d"): 1, (6, "x y"): 1, (5, "p q r s t"): 1})


def test_quality_and_encoding_keep_rows(spark, folder):
    got = ran(spark, folder, "quality classifier", ROWS)
    assert len(got) == len(ROWS) and all(tuple(r)[5:] == TAIL for r in got)
    coded = STAGES["byte-level BPE"](spark, spark.createDataFrame(ROWS, SCHEMA), folder).collect()
    assert len(coded) == len(ROWS) and {r.n_tokens for r in coded if r.doc_id in (3, 4, 9)} == {0}


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, folder, name):
    docs = materialise(spark.createDataFrame([], SCHEMA), "none")
    assert STAGES[name](spark, docs, folder).count() == 0


def test_run_deletes_what_stages_wrote_on_their_way(spark, tmp_path):
    import os

    spark.createDataFrame([(k, f"some words of document {k} here", "en", "s", 1) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(os.listdir(shared)) - before) == 1 and out.filter(F.col("n_tokens") > 0).count() == out.count() == 20
