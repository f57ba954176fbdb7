"""Code lengths against a plain context model, and predictions on planted languages."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from oddsmill.llm import language


def plain_bits(train, text):
    """Prediction by partial matching, method C, straight from its definition."""
    tables = [defaultdict(Counter) for _ in range(language.ORDER + 1)]
    for t in train:
        data = b"\0" * language.ORDER + t
        for k in range(language.ORDER, len(data)):
            for order in range(language.ORDER + 1):
                tables[order][data[k - order : k]][data[k]] += 1
    data, total = b"\0" * language.ORDER + text, 0.0
    for k in range(language.ORDER, len(data)):
        for order in range(language.ORDER, -1, -1):
            seen = tables[order].get(data[k - order : k])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[k] in seen:
                total -= math.log2(seen[data[k]] / whole)
                break
            total -= math.log2(len(seen) / whole)
        else:
            total += 8
    return total


@pytest.mark.parametrize("seed", range(4))
def test_code_lengths(seed):
    draw = random.Random(seed)
    text = lambda: bytes(draw.choices(b"abc \xc3\xa9", k=draw.randint(0, 40)))
    train = [text() for _ in range(20)] + [b"aaaa"]
    strings, n = np.unique(language.codes(train)[0], return_counts=True)
    tree = language.ContextTree(strings, n)
    parts = [text() for _ in range(10)] + [b"zz\x00\xff", b""]
    found, bounds = language.codes(parts)
    bits = tree.bits(found)
    for k, part in enumerate(parts):
        assert bits[bounds[k] : bounds[k + 1]].sum() == pytest.approx(plain_bits(train, part))


def test_planted_languages(spark):
    draw = random.Random(1)
    words = {"en": ["the", "and", "stone", "which"], "de": ["und", "schön", "nicht", "straße"], "qq": ["xoxo", "qix", "zaz", "vux"]}
    rows = [(k, " ".join(draw.choices(words[lang], k=20)), lang, 1) for k in range(150) for lang in [list(words)[k % 3]]]
    rows += [(500, None, "en", 1), (501, "", None, 1), (502, "123 !?", "de", 1), (503, "the stone", None, 1), (503, "the stone", None, 1)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id < 500)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id >= 500} == {500: "und", 501: "und", 502: "und", 503: "en"}
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    got = language.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_empty_table(spark):
    assert language.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
