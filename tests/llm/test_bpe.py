"""The tree encoder against the tiktoken library on whole texts."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import Row

from oddsmill.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["a", "the", "'", "'re", "'ll", " ", "  ", "\n", "\r\n", "\t", "é", "語", "🙂", "1", "2345", "...", "!?", " ", " ", "\x1c", "don't", "<|endoftext|>", "x" * 40, " " * 30, "_"]


@pytest.mark.parametrize("leaf", [4, 7, 16, 61])
def test_tree_equals_whole_text(whole, leaf):
    ranks, library = whole
    tree = bpe.TreeBpe(ranks, P.PATTERN, leaf=leaf, window=4)
    draw = random.Random(leaf)
    for _ in range(400):
        text = "".join(draw.choices(PIECES, k=draw.randint(0, 60)))
        ids = tree.encode(text)
        assert ids == library.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "'" * 3000, "\n" * 3000, "é" * 3000, "ab1!" * 2000])
def test_long_runs(whole, text):
    ranks, library = whole
    tree = bpe.TreeBpe(ranks, P.PATTERN, leaf=100, window=8)
    assert tree.encode(text) == library.encode_ordinary(text)


def test_query_columns(spark, whole):
    rows = [Row(doc_id=1, text="Hello there, world. " * 2000, ids="clash"), Row(doc_id=2, text=None, ids="x"), Row(doc_id=3, text="", ids="x"), Row(doc_id=3, text="", ids="x")]
    got = bpe.round_trip_digests(spark.createDataFrame(rows), PATH, P.PATTERN, leaf=500).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3]
    one = next(r for r in got if r.doc_id == 1)
    ids = whole[1].encode_ordinary(rows[0].text)
    assert one.n_tokens == len(ids)
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert one.decoded_sha256 == hashlib.sha256(rows[0].text.encode()).hexdigest()
    empty = next(r for r in got if r.doc_id == 2)
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "año 2024 — fin"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == {1: "año 2024 — fin", 2: ""}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip_digests(docs, PATH, P.PATTERN).collect() == []
