"""Fill-in-the-middle against a plain version over code points, and the sparse index against Python strings."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oddsmill.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, m, y = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(x), len(m), f"<S>{y}<P>{x}<M>{m}"
    return n, "psm", len(x), len(m), f"<P>{x}<S>{y}<M>{m}"


TEXTS = [
    None, "", " ", " \n\t", "one", " one", "one ", "one two three", "naïve café 日本 語 🙂 x", "🙂🙂 🙂", "a b c d", "x <P> y", "<S>", "a <M>", "< P> <S ><", "tail<", "<S <", "a\x0bb\x0cc\rd",
    "Grüße " * 300, "日本語のテキスト " * 200, "ascii only text " * 400, "\x00 nul \x1f", "é" * 5000, "word " * 60_000,
]


@pytest.mark.parametrize("rate", [50, 100])
def test_against_the_plain_version(spark, rate):
    docs = [(k, TEXTS[k % len(TEXTS)]) for k in range(8 * len(TEXTS))]
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n int, output string").repartition(3)
    rows = fim.rearranged(frame, rate).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r.doc_id, texts[r.doc_id], rate)
        assert r.back == (texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=20), min_size=1, max_size=6))
def test_sparse_index(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(b) for b in raw])
    begins = np.concatenate([[0], ends[:-1]])
    index = fim.SparseIndex(np.frombuffer(b"".join(raw), np.uint8), begins)
    for k, t in enumerate(texts):
        for c in range(len(t) + 1):
            place = begins[k] + len(t[:c].encode())
            assert index.to_bytes(np.array([c]), np.array([k]))[0] == place
            assert index.to_points(np.array([place]), np.array([k]))[0] == c
    places, upto = fim.token_ends(np.frombuffer(b"".join(raw), np.uint8), ends)
    for k, t in enumerate(texts):
        got = places[upto[k] : upto[k + 1]] if raw[k] else []
        want = np.cumsum([len(x.encode()) for x in TOKEN.findall(t)]) + begins[k]
        assert list(got) == list(want)


def test_index_is_sparse():
    data = np.frombuffer(("plain " * 1000 + "ü").encode(), np.uint8)
    assert len(fim.SparseIndex(data, np.array([0])).at) == 1


def test_repeated_rows_null_id_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = fim.rearranged(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], schema), 100).collect()
    assert len(rows) == 4 and rows[0] == rows[1] and all(r.doc_id is not None for r in rows)
    assert fim.rearranged(spark.createDataFrame([], schema)).collect() == []
