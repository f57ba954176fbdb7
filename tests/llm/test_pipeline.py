"""The pipeline against its stages by brute force."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
from test_near_dedup import brute as near_brute

import corpus_pipeline
from oddsmill.llm import bpe
from oddsmill.llm.common import materialise


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("aeioulnrst", k=draw.randint(2, 8)))
    rows = []
    for k in range(120):
        words = [word() for _ in range(draw.randint(12, 60))]
        text = " ".join(words) + "."
        if k % 4 == 3:
            text = " ".join(w.upper() + "!!" for w in words)
        rows.append((k, text, "en", f"s{k % 3}" if k % 10 else None, len(text)))
    for k, of in enumerate((4, 4, 8, 12)):
        rows.append((200 + k, rows[of][1].replace(" ", "  "), "en", "s1", 1))
    rows.append((300, rows[16][1] + " tail", "en", "s2", 1))
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 != 3), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    after = []
    for name, stage in list(steps.items())[:-1]:
        docs = materialise(stage(spark, docs, folder), "test")
        assert docs.columns == columns, name
        after.append([r.doc_id for r in docs.collect()])
    good, exact, near, mixed = after
    assert sorted(good) == sorted(i for i in texts if not (i < 120 and i % 4 == 3))
    norm = lambda i: re.sub(r"[\x20\x09-\x0D]+", " ", texts[i])
    assert sorted(exact) == sorted(min(j for j in good if norm(j) == t) for t in {norm(i) for i in good})
    assert sorted(near) == [i for i, _, _, kept in near_brute([(i, texts[i]) for i in exact]) if kept]
    assert 300 not in near and set(mixed) <= set(near) and max(Counter(mixed).values()) <= 3
    coded = list(steps.values())[-1](spark, docs, folder).collect()
    assert sorted(r.doc_id for r in coded) == sorted(mixed)
    library = bpe.tree_bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).enc
    for r in coded:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()) == sorted(mixed)
