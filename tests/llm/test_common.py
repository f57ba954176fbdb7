"""The bitmap that spares texts a shuffle loses no row."""

import pytest

from oddsmill.llm.common import materialise, maybe_in, without


@pytest.mark.parametrize("step", [1, 3, 97])
def test_no_row_is_lost(spark, step):
    docs = spark.range(-500, 5000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'t' text")
    ids = materialise(spark.range(-500, 5000, step).withColumnRenamed("id", "doc_id"), "ids")
    kept = maybe_in(docs, ids)
    assert kept.columns == docs.columns
    assert kept.join(ids, "doc_id", "left_semi").count() == ids.count()
    assert kept.count() <= ids.count() + 0.15 * docs.count()


def test_beyond_the_bound_all_rows_stay(spark):
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    assert maybe_in(docs, docs.limit(50), most_bits=1 << 9).count() == 100


def test_no_ids(spark):
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    assert maybe_in(docs, docs.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("most", [1 << 28, 1 << 9])
def test_without(spark, most):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'t' text", "1 _p")
    ids = materialise(spark.range(0, 4000, 7).withColumnRenamed("id", "doc_id"), "ids")
    left = without(docs, ids, most)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(2000) if i % 7]
