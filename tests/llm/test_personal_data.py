"""Base spans against Python's patterns, disclosure against counting, redaction by hand."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from oddsmill.llm import personal_data as pd_

PIECES = ["a@b.co", "x.y+z@foo-bar.example.org", "a@b", "@", "_d@e.f", "192.168.0.1", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "0000 0000 0000", "1 2 3 4", "+1 (555) 010-9999", "+49.30.1234567", "+1 2", "+12345678901234567", "é", "语", "🙂", "word", " ", " ", ",", "\n", "7"]


def base(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans(spark):
    draw = random.Random(1)
    rows = [(k, "".join(draw.choices(PIECES, k=draw.randint(0, 25))), 1) for k in range(400)]
    rows += [(900, None, 1), (901, "", 1), (902, "1 " * 3000, 1), (903, "a" * 3000 + "@", 1), (904, "1.1.1.1 " * 300, 1), (5, rows[5][1], 1)]
    got = pd_.listed(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    for r in got:
        want = base(text[r.doc_id])
        plain = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, n, _, _ in want) for k in range(4)]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == plain


def test_terms_that_disclose(spark):
    fill = ["river", "stone", "cloud", "meadow", "harbour", "winter"]
    draw = random.Random(2)
    rows = []
    for k in range(90):
        words = draw.choices(fill, k=20)
        if k < 6:
            words[10:10] = ["Zephyrine", "wrote", "ann@corp.example", "about", "it"]
        if k in (3, 20, 21):
            words += ["wrote"] * 2
        rows.append((k, " ".join(words) + f" {k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r.t: r for r in pd_.disclosing(pd_.texts(docs), pd_.found(pd_.texts(docs)).filter("text_id IS NOT NULL")).collect()}
    assert set(told) == {"zephyrine", "wrote", "about"}
    assert told["zephyrine"].p == 1.0 and told["wrote"].p == 6 / 8
    got = {r.doc_id: r.spans for r in pd_.listed(docs).collect()}
    at = rows[0][1].index("Zephyrine")
    assert f"term:{at}:{at + 9}" in got[0] and "email" in got[0] and got[30] == ""
    clean = {r.doc_id: r.text for r in pd_.sanitised(docs).collect()}
    assert "ann@" not in clean[0] and "[email]" in clean[0] and "Zephyrine" not in clean[0] and "[word]" in clean[0]
    assert clean[30] == rows[30][1]


def test_terms_are_marked_in_every_text(spark):
    """Counts and marks over whole texts, against counting in Python."""
    fill = ["river", "stone", "cloud", "meadow", "harbour", "winter"]
    draw = random.Random(3)
    far = " ".join(draw.choices(fill, k=40))
    rows = [(k, " ".join(draw.choices(fill, k=20)) + f" {k}") for k in range(90)]
    for k in range(6):
        # The term is never near the entity: the old window of 60 characters did not reach it.
        rows[k] = (k, f"Zephyrine {far} ann@corp.example {far} zephyrine corp {k}")
    rows[20] = (20, f"Here ZEPHYRINE stands alone. {' '.join(draw.choices(fill, k=200))} zephyrine")
    rows += [(91, rows[20][1]), (20, rows[20][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    entity, parts = "ann@corp.example", {t: set(re.findall(r"[^\W\d_]{3,}", t.replace("ann@corp.example", "").lower())) for _, t in rows}
    told = {}
    for term in set().union(*parts.values()):
        both, those = sum(entity in t and term in p for t, p in parts.items()), sum(term in re.findall(r"[^\W\d_]{3,}", t.lower()) for t in parts)
        carriers = sum(entity in t for t in parts)
        if both >= pd_.SUPPORT and both / those >= pd_.GENERALISE and both / those * len(parts) / carriers >= 2**pd_.BITS:
            told[term] = both / those
    assert told == {"zephyrine": 6 / 7, "corp": 1.0}

    got = pd_.listed(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        t = text[r.doc_id]
        at = t.find(entity)
        want = sorted(f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", t) if m.group().lower() in told and not (at >= 0 and m.start() < at + len(entity) and m.end() > at))
        assert sorted(x for x in r.spans.split(",") if x.startswith("term")) == want
        assert bool(want) == (r.doc_id < 6 or r.doc_id in (20, 91))
    clean = {r.doc_id: r.text for r in pd_.sanitised(docs).collect()}
    assert all("zephyrine" not in t.lower() for t in clean.values()) and "[long word]" in clean[20]


def test_empty_table_and_native_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = pd_.listed(docs)
    assert out.collect() == []
    plan = pd_.found(docs)._jdf.queryExecution().executedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosure_equals_counting(spark, seed):
    """p and bits of every term and entity, against counting in Python."""
    draw = random.Random(seed)
    people = [(f"p{k}@mail.example", f"+4930123456{k}", [f"{w}{chr(97 + k)}" for w in ("alpha", "bravo", "castle")]) for k in range(5)]
    rows = []
    for k in range(160):
        words = draw.choices(["river", "stone", "cloud", "meadow", "harbour"], k=12)
        if k % 3 == 0:
            mail, phone, own = draw.choice(people)
            words += draw.sample(own, draw.randint(1, 3)) + draw.sample([mail, phone], draw.randint(0, 2))
        draw.shuffle(words)
        rows.append((k, " ".join(words)))
    rows += [(200 + k, rows[3 * k][1]) for k in range(10)]  # equal texts count once
    texts = {t for _, t in rows}
    carried = {t: {("email", m) for m in re.findall(r"\S+@\S+", t)} | {("phone", m) for m in re.findall(r"\+\d+", t)} for t in texts}
    terms = {t: {w for w in t.split() if w.isalpha()} for t in texts}
    want = {}
    for entity in set().union(*carried.values()):
        having = [t for t in texts if entity in carried[t]]
        for term in set().union(*terms.values()) if len(having) >= pd_.SUPPORT else ():
            both, those = sum(term in terms[t] for t in having), sum(term in terms[t] for t in texts)
            p = both / those
            if both >= pd_.SUPPORT and p >= pd_.GENERALISE and (bits := math.log2(p * len(texts) / len(having))) >= pd_.BITS:
                want[(*entity, term)] = (p, bits)
    docs = pd_.texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(pd_.KINDS[r.kind], r.v, r.t): (r.p, r.bits) for r in pd_.disclosing(docs, pd_.found(docs).filter("text_id IS NOT NULL")).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_text_with_many_spans(spark):
    text = " ".join(f"word name{k}@host{k}.example 10.0.{k % 300}.1 tail" for k in range(3000))
    row = pd_.listed(spark.createDataFrame([(1, text), (None, "a@b.example")], "doc_id long, text string")).collect()
    got = {r.n_email: r.n_ip for r in row}
    assert got == {3000: sum(k % 300 <= 255 for k in range(3000)), 1: 0}
    free = spark.createDataFrame([(text,)], "t string").select(pd_.free_terms(F.col("t"), pd_.base_spans(F.col("t"))).alias("f")).first().f
    assert len(free) == 6000 and {x.t for x in free} == {"word", "tail"}


def test_disclosure_is_found_in_long_lists(spark):
    told = sorted((f"t{k * 7 % 2000:04d}é", k / 2000) for k in range(0, 2000, 3))
    asked = [t for t, _ in told] + ["", "a", "t0001", "zz", "é"]
    rows = spark.createDataFrame([(told, t) for t in asked] + [([], "a")], "told array<struct<t:string,p:double>>, t string")
    got = rows.select("t", F.size("told").alias("n"), pd_._disclosure(F.col("told"), F.col("t")).alias("p")).collect()
    known = dict(told)
    assert all(r.p == (known.get(r.t) if r.n else None) for r in got) and sum(r.p is not None for r in got) == len(told)
