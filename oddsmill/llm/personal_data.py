"""Personal data: patterns for protected entities, and terms that reveal them.

Base spans are found by pattern: e-mail and IP addresses, payment cards (Luhn) and
phone numbers.  The corpus then tells which ordinary terms give an entity away.  A
term that stands in a text with an entity, anywhere outside its base spans, in at
least ``SUPPORT`` different texts discloses it by ``p = texts with both / texts with
the term``; its information is ``log2(p / (texts with the entity / texts))`` bits.
With at least ``BITS`` bits, a term of ``p >= REMOVE`` is removed and one of
``p >= GENERALISE`` is generalised to its length class, wherever it stands in any
text.  A term that discloses several entities goes by its highest ``p``.

Everything is built-in functions: no Python runs on the executors.  Counts cover
all texts.

Edge cases: a null text is empty and has no span; equal texts count once in the
statistics; repeated rows get equal results; base spans of different kinds may
overlap, term spans never overlap a base span; a null ``doc_id`` is named by a hash of
the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import joined, materialise, maybe_in, replicated, sifted, texts, with_salt

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
GENERALISE, REMOVE = 0.5, 0.9
BITS = 3.0
TERM = r"\p{L}{3,}"
#: Matches whose places are added up together, and copies of each entity and disclosing term in the join with its texts.
BLOCK, SALTS = 64, 16

# Possessive forms of the contract's patterns.  A match may begin where the last one ended or where its
# first character class begins: elsewhere within such a run an attempt fails as it does at the run's start.
_PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(k: Column) -> Column:
        d = F.substring(back, k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, k: acc + worth(k)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.when(F.length(part(p)) <= 3, part(p)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def places(text: Column, pattern: str) -> Column:
    """Structs (s, e, v) of the matches of a pattern, in code points: start, end, text."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["v"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

    def added(pairs: Column) -> Column:
        """Places within blocks, then those of the blocks: an aggregate copies its array at each step."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)))
        within = F.transform(blocks, lambda b: F.aggregate(b, empty, step))
        moved = lambda b, at: F.transform(b["out"], lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["v"].alias("v")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,v:string>>>").alias("out"))
        return F.aggregate(within, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved(b, acc["at"]))).alias("out")), lambda acc: F.flatten(acc["out"]))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    # As the value of a lambda the pairs are found once, not once a block.
    return F.element_at(F.transform(F.array(pairs), lambda x: F.when(F.size(x) > 0, added(x)).otherwise(none)), 1)


_SPANS = "array<struct<s:int,e:int,kind:int,v:string>>"


def base_spans(text: Column) -> Column:
    """All valid base spans of a text, ordered by start, then kind."""

    def of(kind: str) -> Column:
        pattern, sign = _PATTERNS[kind]
        valid = F.filter(places(text, pattern), lambda x: _valid(kind, x["v"]))
        tagged = F.transform(valid, lambda x: F.struct(x["s"], x["e"], F.lit(KINDS.index(kind)).alias("kind"), x["v"]))
        present = text.contains(sign) if sign else F.lit(True)
        present = present if kind == "email" else present & text.rlike("[0-9]")
        return F.when(present, tagged).otherwise(F.array().cast(_SPANS))

    both = F.concat(*[of(kind) for kind in _PATTERNS])
    return F.array_sort(both, lambda x, y: F.when(x["s"] != y["s"], x["s"] - y["s"]).otherwise(x["kind"] - y["kind"]))


def _searched(own: Column, before: Callable[[Column], Column], done: Callable[[Column], Column]) -> Column:
    """``done`` of the place of the first element of the ordered ``own`` that is not ``before``, by binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(own).alias("hi"))

    def half(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        low = before(F.get(own, mid))
        return F.when(acc["lo"] < acc["hi"], F.struct(F.when(low, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))).otherwise(acc)

    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(own) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, start, half, lambda acc: done(acc["lo"]))


def _overlaps(own: Column, p: Column) -> Column:
    """Whether one of the spans ``own`` (in order, none in another) holds a part of ``p``."""
    return (F.size(own) > 0) & _searched(own, lambda x: x["s"] < p["e"], lambda lo: F.coalesce(F.get(own, lo - 1)["e"] > p["s"], F.lit(False)))


def _disclosure(told: Column, t: Column) -> Column:
    """``p`` of the term ``t`` among the structs (t, p) of ``told``, which are in order; else NULL."""

    def of(lo: Column) -> Column:
        x = F.get(told, lo)
        return F.when(x["t"] == t, x["p"])

    return _searched(told, lambda x: x["t"] < t, of)


def free_terms(text: Column, spans: Column) -> Column:
    """Structs (s, e, t) of the terms of a text that touch no base span: place and lower-case form."""
    of = lambda k: F.filter(spans, lambda b: b["kind"] == k)
    by_kind = F.filter(F.array(*[of(k) for k in range(len(_PATTERNS))]), lambda own: F.size(own) > 0)
    # Spans of one kind do not overlap; they are parted once, not once a term.
    free = F.transform(F.array(by_kind), lambda kinds: F.filter(places(text, TERM), lambda p: ~F.exists(kinds, lambda own: _overlaps(own, p))))[0]
    return F.transform(free, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.lower(p["v"]).alias("t")))


def distinct_terms(text: Column) -> Column:
    """Lower-case forms of all terms of a text; only these two letters have another form, or other bounds, in a text lowered as a whole."""
    of = lambda t: F.regexp_extract_all(t, F.lit(TERM), F.lit(0))
    return F.array_distinct(F.when(text.rlike("[\u0130\u03a3]"), F.transform(of(text), F.lower)).otherwise(of(F.lower(text))))


def found(docs: DataFrame) -> DataFrame:
    """``doc_id, spans, text_id, terms`` of every row: base spans, and if there are any a hash of the text and its distinct free terms."""
    rows = docs.select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    terms = F.array_distinct(F.transform(free_terms(F.col("text"), F.col("spans")), lambda p: p["t"]))
    some = F.size("spans") > 0
    return rows.select("doc_id", "spans", F.when(some, F.xxhash64("text")).alias("text_id"), F.when(some, terms).alias("terms"))


def _words_of_texts(docs: DataFrame) -> DataFrame:
    """``t``: the distinct terms of each distinct text. Only texts that may have copies are grouped."""
    rows = docs.select("text", F.xxhash64("text").alias("text_id"))
    copied = materialise(rows.groupBy("text_id").agg(F.count("*").alias("n")).filter("n > 1").select("text_id"), "copied-texts")
    alone, again = sifted(rows, copied, "text_id")
    once = again.groupBy("text_id").agg(F.first("text").alias("text"))
    return alone.select("text").unionByName(once.select("text")).select(F.explode(distinct_terms(F.col("text"))).alias("t"))


def disclosing(docs: DataFrame, base: DataFrame) -> DataFrame:
    """``kind, v, t, p, bits``: terms t that disclose the entity (kind, v)."""
    total = docs.select(F.xxhash64("text").alias("text_id")).distinct().agg(F.count("*").alias("texts"))
    carried = base.select("text_id", F.explode("spans").alias("x")).select("text_id", "x.kind", "x.v").distinct()
    entities = carried.groupBy("kind", "v").agg(F.count("*").alias("with_entity")).filter(F.col("with_entity") >= SUPPORT)
    # As p <= 1, an entity in more texts than this has no term of BITS bits.
    entities = entities.join(F.broadcast(total)).filter(F.col("with_entity") * 2**BITS <= F.col("texts"))  # one row
    held = base.select("text_id", "terms").dropDuplicates(["text_id"])
    # Salted: an entity may stand in an eighth of all texts.
    met = with_salt(carried, "text_id", SALTS).join(replicated(entities, SALTS), ["kind", "v", "salt"])
    pairs = met.join(held, "text_id").select("kind", "v", "with_entity", "texts", F.explode("terms").alias("t"))
    pairs = materialise(pairs.groupBy("kind", "v", "with_entity", "texts", "t").agg(F.count("*").alias("both")).filter(F.col("both") >= SUPPORT), "term-pairs")
    terms = materialise(pairs.select("t").distinct(), "terms")
    # The exact join comes after the counting: one row a term instead of one a text and term.
    rows = pairs.join(maybe_in(_words_of_texts(docs), terms, key="t").groupBy("t").agg(F.count("*").alias("with_term")), "t")
    p = F.col("both") / F.col("with_term")
    bits = F.log2(p * F.col("texts") / F.col("with_entity"))
    return rows.select("kind", "v", "t", p.alias("p"), bits.alias("bits")).filter((F.col("p") >= GENERALISE) & (F.col("bits") >= BITS))


def marked(docs: DataFrame, base: DataFrame, told: DataFrame) -> DataFrame:
    """``doc_id, terms``: the places (s, e, p) of the terms of ``told`` in every text that has one, off its base spans."""
    marks = materialise(told.groupBy("t").agg(F.max("p").alias("p")), "marks")
    words = maybe_in(docs.select("doc_id", F.explode(distinct_terms(F.col("text"))).alias("t")), marks.select("t"), key="t")
    # Salted: a term may be told in up to a quarter of the texts, and copies of a text count again here.
    met = with_salt(words, "doc_id", SALTS).join(replicated(marks, SALTS), ["t", "salt"])
    lists = materialise(met.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("t", "p"))).alias("told")), "marked")
    rows = maybe_in(docs, lists).join(lists, "doc_id").dropDuplicates(["doc_id"]).join(base.select("doc_id", "spans").dropDuplicates(["doc_id"]), "doc_id")
    places = F.transform(free_terms(F.col("text"), F.col("spans")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _disclosure(F.col("told"), x["t"]).alias("p")))
    return rows.select("doc_id", F.filter(places, lambda x: x["p"].isNotNull()).alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, terms`` for every row of ``docs``: base spans, and term spans with their disclosure ``p``."""
    docs = texts(docs)
    base = materialise(found(docs), "base-spans")
    told = materialise(disclosing(docs, base.filter("text_id IS NOT NULL")), "disclosing")
    return base.select("doc_id", F.col("spans").alias("base")).join(marked(docs, base, told), "doc_id", "left")


def listed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row."""
    rows = spans(docs)
    name = F.array(*[F.lit(k) for k in KINDS])

    def text(x: Column) -> Column:
        return F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))

    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,p:double>>")), lambda x: F.struct(x["s"], x["e"], F.lit(4).alias("kind")))
    both = F.concat(F.transform("base", lambda x: F.struct(x["s"], x["e"], x["kind"])), terms)
    ordered = F.array_sort(both, lambda x, y: F.when(x["s"] != y["s"], x["s"] - y["s"]).when(x["kind"] != y["kind"], x["kind"] - y["kind"]).otherwise(x["e"] - y["e"]))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.transform("base", text)), 256).alias("base_sha256"), joined(F.transform(ordered, text)).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with entities replaced by their kind, disclosing terms removed or generalised."""
    docs = texts(docs)
    rows = docs.join(spans(docs).dropDuplicates(["doc_id"]), "doc_id")
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    base = F.transform("base", lambda x: F.struct(x["s"], x["e"], F.element_at(name, x["kind"] + 1).alias("by")))
    by = lambda x: F.when(x["p"] >= REMOVE, F.lit("")).when(x["e"] - x["s"] > 6, F.lit("[long word]")).otherwise(F.lit("[word]"))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,p:double>>")), lambda x: F.struct(x["s"], x["e"], by(x).alias("by")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        fresh = F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, x["by"]).alias("out"))
        inside = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["s"] >= acc["at"], fresh).otherwise(inside)

    done = lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text")))
    return rows.select("doc_id", F.aggregate(F.array_sort(F.concat(base, terms)), start, step, done).alias("text"))
