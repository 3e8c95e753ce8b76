"""Personal data: base spans by pattern, further terms by what the corpus says they reveal (DataFrame functions only).

Base kinds email, ip, card and phone are found leftmost and non-overlapping per kind, then checked (parts of at most
255, Luhn, digit counts). Their normalised values are the protected entities. A term is a run of three or more letters of a
word without digits or @. With n distinct texts, c_e of them with the entity, c_t with the term and c_et with both, its
disclosure is

    PMI(e; t) / IC(e) = 1 - log(c_t / c_et) / log(n / c_e),

the share of the entity's information content that the term gives away. A term with c_et >= `support` and disclosure
>= `threshold` for any entity is removed from every text; base spans are generalised to their kind. An address that
a large part of all texts carry meets many rare words in every text of theirs by chance, so the texts together must speak for
more than chance: c_et * log(n / c_e) >= log(n * `doubt`), where exp(-c_et * log(n / c_e)) is the chance that c_et texts drawn
at random all name the entity.

Defined results: null text is empty and has no spans; texts without mentions or flagged terms are unchanged; repeated rows get
equal results and count once in the corpus; ties of start are in the order of the kinds; an empty table gives no rows; all
input columns are kept, of any name, but for spans and base_spans, which are replaced. The text itself is left to clean().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.folds import chunks, fold
from quirefold.llm.common import materialize, small_batches

#: Kinds in the order of ties: fixed values. Possessive quantifiers and the left border spare the regex engine
#: retries; they match the same strings as the plain forms.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
_IP_OK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return total + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(_IP_OK)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _value(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lower(m)
    if kind == "term":
        return F.lower(m)
    if kind == "ip":
        return F.regexp_replace(m, r"(^|\.)0+(?=[0-9])", "$1")
    return _digits(m)


def _located(text: Column, pattern: str, kind: str, at_all: Column, valid: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a pattern: matches and the gaps between them give the places."""
    p = F.lit(pattern)
    none = F.array().cast("array<string>")
    both = F.when(at_all, F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, p, -1).alias("g"))).otherwise(F.arrays_zip(none.alias("m"), none.alias("g")))
    rank = KINDS.index(kind)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), _value(kind, x["m"]).alias("value")).cast(_SPAN)
        m = F.coalesce(x["m"], F.lit(""))
        return end, F.when(x["m"].isNotNull() & (valid(m) if valid else _valid(kind, m)), span)

    matches = lambda both: fold(both, F.lit(0), "bigint", _SPAN, step)["items"]
    return F.element_at(F.transform(F.array(both), matches), 1)


def _clear(base: Column, terms: Column) -> Column:
    """The terms that overlap no base span, in one walk over both by start. Terms do not overlap each other."""
    carry = f"struct<reach:bigint,held:{_SPAN}>"

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        term, held = x["kind"] == "term", a["held"]
        hit = ~term & (x["start"] < held["end"])  # a base span that begins within the term before it
        reach = F.when(term, a["reach"]).otherwise(F.greatest(a["reach"], x["end"]))
        after = F.struct(reach.alias("reach"), F.when(term & (x["start"] >= a["reach"]), x).alias("held"))
        return after, F.when(held.isNotNull() & ~hit, held)

    walk = lambda both: fold(both, F.struct(F.lit(0).alias("reach"), F.lit(None).alias("held")), carry, _SPAN, step)
    end = lambda a: F.concat(a["items"], F.when(a["carry"]["held"].isNull(), F.array().cast(f"array<{_SPAN}>")).otherwise(F.array(a["carry"]["held"])))
    walked = F.transform(F.transform(F.array(F.sort_array(F.concat(base, terms))), walk), end)
    return F.when(F.size(terms) == 0, terms).otherwise(F.element_at(walked, 1))


def with_base(docs: DataFrame) -> DataFrame:
    """docs with base_spans (sorted by start, then kind) and text_key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = [
        _located(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        _located(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        _located(text, CARD, "card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
        _located(text, PHONE, "phone", text.rlike(r"\+[0-9]")),
    ]
    return docs.withColumn("base_spans", F.sort_array(F.concat(*kinds))).withColumn("text_key", F.md5(text.cast("binary")))


def _terms(text: Column) -> Column:
    """Lower-cased runs of letters of words without digits or @."""
    plain = F.regexp_replace(text, r"\S*[@0-9]\S*", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"\p{L}{3,}"), F.lit(0)), F.lower))


def flagged_terms(docs: DataFrame, support: int = 3, threshold: float = 0.9, doubt: float = 1000.0) -> DataFrame:
    """(term, disclosure): the terms that give an entity away, with the most that each tells of any."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(whole.alias("text")).withColumn("text_key", F.md5(F.col("text").cast("binary")))
    n = texts.select("text_key").distinct().count()
    entity = F.explode(F.array_distinct(F.transform("base_spans", lambda s: F.concat_ws(":", s["kind"], s["value"]))))
    mentions = materialize(with_base(texts.select("text")).where(F.size("base_spans") > 0).dropDuplicates(["text_key"]).select("text_key", "text", "base_spans"), "pii-mentions")
    held = materialize(mentions.select("text_key", entity.alias("entity")), "pii-held")
    # Entities, and terms, that stand in the same texts tell the same: each set of texts is one class, known by its size and two 64-bit sums.
    sums = lambda k: (F.bit_xor(F.xxhash64("text_key")).alias(f"{k}1"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias(f"{k}2"))
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"), *sums("e")).where((F.col("c_e") >= support) & (F.col("c_e") < n))  # in all texts: nothing to tell
    held = materialize(held.join(entities, "entity").select("text_key", "c_e", "e1", "e2").distinct(), "pii-entities")
    # The exchange is of texts, one of each task's copies; terms are summed in each task before theirs.
    # explode_outer: a plain explode would be preceded by a filter that finds the terms a second time
    used = texts.dropDuplicates(["text_key"]).select("text_key", F.explode_outer(_terms(F.col("text"))).alias("term"))
    frequency = used.groupBy("term").agg(F.count(F.lit(1)).alias("c_t"), *sums("t")).where(F.col("c_t") >= support)

    def told_by(both: Column) -> Column:
        """Whether a term that shares `both` texts with an entity can be flagged."""
        content = F.log(F.lit(float(n)) / F.col("c_e"))
        return (1 - F.log(F.col("c_t") / both) / content >= threshold) & (both * content >= F.log(F.lit(n * doubt)))

    # c_et is c_e and c_t at most: a term too common for the most common entity of a text can be left out before pairs are made.
    near = mentions.join(held.groupBy("text_key").agg(F.max("c_e").alias("c_e")), "text_key")
    near = near.select("text_key", "c_e", F.explode_outer(_terms(F.col("text"))).alias("term")).join(frequency, "term")
    near = near.where(1 - F.log(F.col("c_t") / F.least("c_e", "c_t")) / F.log(F.lit(float(n)) / F.col("c_e")) >= threshold).select("text_key", "term", "c_t", "t1", "t2")
    near = materialize(near, "pii-near")
    terms = ["c_t", "t1", "t2"]
    pairs = near.select("text_key", *terms).distinct().join(held, "text_key").where(told_by(F.least("c_e", "c_t")))
    pairs = pairs.groupBy("c_e", "e1", "e2", *terms).agg(F.count(F.lit(1)).alias("c_et")).where(F.col("c_et") >= support)
    told = pairs.where(told_by(F.col("c_et"))).withColumn("disclosure", 1 - F.log(F.col("c_t") / F.col("c_et")) / F.log(F.lit(float(n)) / F.col("c_e")))
    told = told.groupBy(*terms).agg(F.max("disclosure").alias("disclosure"))
    return materialize(near.select("term", *terms).distinct().join(told, terms).select("term", "disclosure"), "pii-flagged")


def find(docs: DataFrame, support: int = 3, threshold: float = 0.9, doubt: float = 1000.0) -> DataFrame:
    """docs with base_spans and spans (base and term spans), arrays of {start, rank, end, kind, value}."""
    small_batches(docs.sparkSession)
    flagged = flagged_terms(docs.select("text"), support, threshold, doubt).select("term")
    kept = [c for c in docs.columns if c.lower() not in ("spans", "base_spans")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = rows.select(F.md5(F.col("text").cast("binary")).alias("text_key"), F.explode_outer(_terms(F.col("text"))).alias("term")).join(flagged, "term", "left_semi")
    told = materialize(told.groupBy("text_key").agg(F.sort_array(F.collect_set("term")).alias("terms")), "pii-terms")
    joined = with_base(rows).join(told, "text_key", "left")
    found = _located(F.col("text"), r"\p{L}{3,}+", "term", F.col("terms").isNotNull(), lambda m: F.array_contains("terms", F.lower(m)))
    clear = _clear(F.col("base_spans"), F.col("found"))
    out = joined.withColumn("found", found).select("row", "base_spans", F.sort_array(F.concat("base_spans", clear)).alias("spans"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "base_spans", "spans")


def clean(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to their kind and terms removed; overlapping spans give one mark."""
    whole = F.coalesce(text, F.lit(""))

    numbers, part = chunks(spans)

    def many(a: Column, k: Column) -> Column:
        """A chunk of spans: cut out of the part of the text between its places, not out of the whole."""
        upto = F.greatest(a["at"], F.array_max(F.transform(part(k), lambda s: s["end"])))
        here = F.substring(whole, (a["at"] + 1).cast("int"), (upto - a["at"]).cast("int"))

        def step(b: Column, s: Column) -> Column:
            mark = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            kept = F.substring(b["here"], (b["at"] - a["at"] + 1).cast("int"), (s["start"] - b["at"]).cast("int"))
            out = F.when(s["start"] >= b["at"], F.concat(b["out"], F.array(kept, mark))).otherwise(b["out"])
            return F.struct(F.greatest(b["at"], s["end"]).alias("at"), b["here"].alias("here"), out.alias("out"))

        begin = F.struct(a["at"].alias("at"), here.alias("here"), F.array().cast("array<string>").alias("out"))
        done = lambda b: F.struct(b["at"].alias("at"), F.concat(a["out"], F.array(F.array_join(b["out"], ""))).alias("out"))
        return F.aggregate(part(k), begin, step, done)

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(whole, (a["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(numbers, begin, many, rest))


def span_list(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
