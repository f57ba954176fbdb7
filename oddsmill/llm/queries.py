"""The queries ``opN_<name>`` over the synthetic tables, and their DuckDB SQL.

Each query applies one operator, with its production parameters, to the whole
table ``documents`` (``embeddings`` for op11) and derives the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm import bpe, exact_dedup, fim, language, mixing, near_dedup, packing, personal_data, quality, repeats, token_files, version_sketch, whitening
from oddsmill.llm.common import documents

#: Vocabulary files: installed on every node, given by path, never copied.
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEPARATOR_ID = 0


def op1_version_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_sketch.versions(documents(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.listed(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_ID)


def op10_run_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.listed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.with_crc32(packing.sequences(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), SEPARATOR_ID))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.rearranged(documents(spark, sf_dir))
    back = fim.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_version_sketch": op1_version_sketch,
    "op2_personal_data": op2_personal_data,
    "op3_quality": op3_quality,
    "op4_language_ppm": op4_language_ppm,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_entropy_mix": op7_entropy_mix,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_token_files": op9_token_files,
    "op10_run_index_repeats": op10_run_index_repeats,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_window_packing": op12_window_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS s FROM documents),
        u AS (
          SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                 ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4
          FROM d),
        k AS (
          SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
          FROM u),
        c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS x FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM c
    """,
}
