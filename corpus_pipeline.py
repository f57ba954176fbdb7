"""From raw documents to encoded training data in five stages.

Every stage reads what its predecessor kept, written as Parquet in the shared
folder; its decisions take effect in what it returns.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm import bpe, exact_dedup, mixing, near_dedup, quality
from oddsmill.llm.common import documents, replaced, scratch, small_batches
from oddsmill.llm.language import held_out
from oddsmill.llm.queries import BPE_RANKS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below the threshold) go.

    A null or empty text is scored as an empty one; repeated rows go or stay together;
    rows without ``doc_id`` or label are scored and not learnt from; all columns are
    returned as they are; an empty table stays empty.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels.filter(~held_out(5, 0)))
    return docs.filter(quality.scores_of(model, spark)(F.col("text")) >= quality.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the one with the smallest doc_id stays.

    Null and empty texts are equal to each other; of repeated rows one stays; a row
    without ``doc_id`` is named by a hash of its text; all columns of a row that stays are
    returned, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Texts without words (null, empty) are near to nothing and stay; of repeated rows one
    stays; a row without ``doc_id`` is named by a hash of its text; all columns of a row
    that stays are returned, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it takes 0 times go.

    Texts without words (null, empty) are taken 0 times; repeated rows are documents of
    their own; a null source is one more source; a row without ``doc_id`` is named by a
    hash of its text; all columns are returned, whatever their names; an empty table stays
    empty.
    """
    return mixing.repeated_by_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, their digest, and the digest of the bytes that they decode to.

    A null text is empty and has no ids; repeated rows are encoded alike; other columns
    are not read; an empty table stays empty.
    """
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: No SQL: the classifier, the mix and the encoder can't be written in it. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        # What a stage wrote on its way is deleted once its result is written.
        with scratch(spark) as keep:
            docs = keep(replaced(stage(spark, docs, sf_dir), f"stage-{k}", docs))
    return docs
