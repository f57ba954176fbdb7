"""Token files against encoding whole texts with the library."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from oddsmill.llm import token_files

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


PIECES = ["a", "the", "'re", "don't", " ", " ", " ", "  ", "\n", "\t", "\r\n", "é", "語", "12", "...", "\xa0", " ", "\x1c", "<|endoftext|>", "|", "*** "]


def test_units_equal_whole_texts(library):
    encoder = token_files.UnitEncoder(PATH, kept=50)
    draw = random.Random(5)
    batch = ["".join(draw.choices(PIECES, k=draw.randint(0, 25))) for _ in range(3000)]
    for at in range(0, len(batch), 100):
        values, ends = encoder.encode(pa.array(batch[at : at + 100]), 2)
        for text, a, b in zip(batch[at : at + 100], [0, *ends.tolist()], ends.tolist(), strict=False):
            assert values[a:b].tolist() == [*library(text), 2], repr(text)


def test_slices_cover_a_batch(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["", "a" * 30, "bc", "", "d" * 9])], ["text"])
    parts = list(token_files.slices(batch, 0))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist() and len(parts) == 2


def test_round_trip(spark, library):
    rows = [(k * 7 % 50, f"word {k} and more\n" * (k % 9), 1, "z") for k in range(50)] + [(60, None, 1, "z"), (61, "", 1, "z"), (3, "again", 1, "z"), (3, "again", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(docs, PATH, 2).collect())
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(i, []).append([*library(text or ""), 2])
    want, start = [], 0
    order = sorted((i, zlib.crc32(np.array(x, "<u4").tobytes()), x) for i, many in ids.items() for x in many)
    for i, crc, x in order:
        want.append((i, start, len(x), crc))
        start += len(x)
    assert got == sorted(want)


def test_files_are_ordered_and_read_selectively(spark, tmp_path):
    docs = spark.createDataFrame([(k, "some words here " * 50) for k in range(200)], "doc_id long, text string")
    token_files.write_tokens(docs, str(tmp_path / "t"), PATH, 2, 3)
    got = token_files.read_tokens(spark, str(tmp_path / "t"))
    spans = got.groupBy("file_no").agg({"doc_id": "min"}).orderBy("file_no").collect()
    assert [r[1] for r in spans] == sorted(r[1] for r in spans)
    plan = got.select("doc_id", "n_tokens").filter("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,7)" in plan


def test_empty_table(spark):
    assert token_files.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).collect() == []
