"""The stages of the pipeline that run Python get their rows in small batches."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oddsmill.llm import common

STAGES = dict(corpus_pipeline.STAGES)
TEXT = 4_000


@pytest.fixture
def unlimited(spark):
    """The session without a limit; as it was before after the test."""
    before = spark.conf.get(common._BATCH_LIMIT, None)
    spark.conf.unset(common._BATCH_LIMIT)
    yield spark
    spark.conf.unset(common._BATCH_LIMIT)
    if before is not None:
        spark.conf.set(common._BATCH_LIMIT, before)


def batches(spark) -> list[int]:
    """Rows of each batch in which Python gets 2,000 texts of one partition."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], ["n"])

    docs = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("x"), TEXT).alias("text"), "id")
    return [r.n for r in docs.mapInArrow(rows, "n long").collect()]


@pytest.mark.parametrize("name", ["quality classifier", "exact dedup", "minhash near-dedup", "byte-level BPE"])
def test_stage_bounds_batches(unlimited, tmp_path, name):
    unlimited.createDataFrame([(1, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = unlimited.createDataFrame([(1, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    assert STAGES[name](unlimited, docs, str(tmp_path)).count() <= 1
    found = batches(unlimited)
    assert sum(found) == 2_000
    assert max(found) * TEXT <= 2 * common.BATCH_BYTES


def test_limit_of_the_session_stays(unlimited):
    unlimited.conf.set(common._BATCH_LIMIT, "65536")
    common.small_batches(unlimited)
    assert unlimited.conf.get(common._BATCH_LIMIT) == "65536"
