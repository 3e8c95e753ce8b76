"""Chat formatting, fingerprints and personal data against plain restatements."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.llm import chat, fingerprints, pii

CONVERSATIONS = [
    (1, 0, "system", "be <|end|>\n kind"), (1, 1, "user", "a \\ b"), (1, 2, "user", "<|part|>"), (1, 3, "assistant", "x<"), (1, 4, "assistant", "|role|>\\"),
    (2, 1, "assistant", None), (2, 1, "assistant", "é"), (2, None, None, "no turn"), (None, 0, "user", "no id"), (3, 5, "user", ""), (3, 5, "user", ""),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chats(df).select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        mine = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in CONVERSATIONS if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, role, text in mine]
        assert r["loss"] == [text for _, role, text in mine if role == "assistant"]
        masked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert not any("<|" in m for m in masked)
    assert len(out) == 4 and chat.format_chats(df.limit(0)).count() == 0
    merged = next(r for r in out if r["conv_id"] == 1)["formatted"]
    assert merged.count("<|role|>") == 3 and merged.count("<|part|>") == 2


def test_a_very_long_conversation(spark):
    """Its work must not grow with the square of its turns."""
    import time

    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    began = time.time()
    out = chat.format_chats(df).select(chat.read_turns(F.col("formatted")).alias("t"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss")).first()
    assert [x["text"] for x in out["t"]] == [f"t{k}" for k in range(n)] and out["loss"] == "".join(f"t{k}" for k in range(n) if k % 3)
    assert time.time() - began < 60


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints_neighbours(docs, all_rows):
    rows = fingerprints.with_neighbour(docs, buckets=4)
    got = rows.select("*", fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near"), fingerprints.distinct_shingles(F.col("sketch")).alias("n"), fingerprints.containment(F.col("sketch"), F.col("next_sketch")).alias("c")).collect()
    mine = sorted(((i if i is not None else -1, t or "") for i, t, *_ in all_rows))
    pairs = {(a, b) for a, b in zip(mine, mine[1:] + mine[:1], strict=True)}
    assert len(got) == len(all_rows)
    for r in got:
        assert any(a == (r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) and b[1] == r["next_text"] for a, b in pairs)
        a, b = shingles(r["text"]), shingles(r["next_text"])
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near"] - exact) <= 0.15 and abs(r["n"] - len(a)) <= 0.4 * len(a)
        if len(a) < 128 and len(b) < 128:
            assert abs(r["near"] - exact) < 1e-12 and r["n"] == len(a)
            assert abs(r["c"] - (len(a & b) / len(a) if a else 0)) < 1e-9
    assert fingerprints.with_neighbour(docs.limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 7, 60])
def test_neighbours_in_many_ranges(spark, buckets):
    """One next row for each, by hand, where a third of the rows have no id and ids have gaps and repeats."""
    rng = random.Random(buckets)
    rows = [(None if k % 3 == 0 else rng.choice([k, 5, 10**12 + k]), "".join(rng.choice("aäb ") for _ in range(rng.randint(0, 12))) or None) for k in range(400)]
    got = fingerprints.with_neighbour(spark.createDataFrame(rows, "doc_id long, text string"), buckets=buckets).select("doc_id", "text", "next_text").collect()
    order = sorted(((i is not None, i or 0, (t or "").encode()) for i, t in rows))
    want = Counter((i if known else None, t.decode(), after.decode()) for (known, i, t), (*_, after) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter(tuple(r) for r in got) == want


def test_sketches_merge(spark):
    rows = spark.createDataFrame([("a b c d e f g h", "h i j k l m n")], "x string, y string")
    s = fingerprints.with_sketch(fingerprints.with_sketch(rows, "x", "p", 4), "y", "q", 4)
    r = s.select("p", "q", fingerprints.merge(F.col("p"), F.col("q"), 4).alias("m")).first()
    assert r["m"] == sorted({*r["p"], *r["q"]})[:4]


PII = [
    "mail a.b@c.de. and x@y, x@y.z_q@r.st a@b.c",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.001 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 x " + "1" * 30,
    "phone +1 (415) 555-2671 +12 +49 30 1234567890123456",
    "",
    None,
]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(checks) for m in re.finditer(p, t or "") if ok(m.group()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def test_pii_base_spans(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PII)], "doc_id long, text string, spans string")
    got = pii.find(df).select("doc_id", pii.span_list(F.col("base_spans")).alias("s"), pii.clean(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: base_spans(t) for i, t in enumerate(PII)}
    by_id = {r["doc_id"]: r["clean"] for r in got}
    assert by_id[4] == "" and by_id[5] is None and "[CARD]" in by_id[2] and "4111 1111" not in by_id[2]
    assert pii.find(df.limit(0)).count() == 0


def test_pii_revealing_terms(spark):
    mail = "jo@ex.org"
    told = [f"note {i} the keeper Zanzibarian wrote to {mail} today about ships {i * 7}" for i in range(5)]
    plain = [f"nothing here today about the ships and the harbour number {i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(told + plain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["s"], r["clean"]) for r in pii.find(df).select("doc_id", pii.span_list(F.col("spans")).alias("s"), pii.clean(F.col("text"), F.col("spans")).alias("clean")).collect()}
    for i in range(5):
        at = told[i].index("Zanzibarian")
        assert f"term:{at}:{at + 11}" in got[i][0] and "Zanzibarian" not in got[i][1] and "[EMAIL]" in got[i][1]
        assert "today" in got[i][1] and "the" in got[i][1]
    assert all(got[i] == ("", rows[i][1]) for i in range(5, 65))


def test_pii_exact_copies_count_once(spark):
    told = [f"note {i} the keeper Zanzibarian wrote to jo@ex.org today about ships {i * 7}" for i in range(4)]
    plain = [f"nothing here today about the ships and the harbour number {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(told + plain + told[:1] * 300)), "doc_id long, text string")
    got = pii.find(df).select("text", pii.clean(F.col("text"), F.col("spans")).alias("clean")).where("text like 'note%'").collect()
    assert len(got) == 304 and not any("Zanzibarian" in r["clean"] for r in got) and all("today" in r["clean"] for r in got)


def test_pii_terms_of_the_whole_text(spark):
    """A name far from the address, and in a text without it."""
    far = " ".join(f"about the ships and harbours number {k}" for k in range(8))
    told = [f"The keeper Zanzibarian {i} writes. {far} {i * 7} jo@ex.org" for i in range(5)]
    alone = "today the ships of Zanzibarian are here"
    plain = [f"{far} nothing writes here today keeper are number {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate([*told, alone, *plain])), "doc_id long, text string")
    got = {r["doc_id"]: (r["s"], r["clean"]) for r in pii.find(df).select("doc_id", pii.span_list(F.col("spans")).alias("s"), pii.clean(F.col("text"), F.col("spans")).alias("clean")).collect()}
    for i, t in enumerate([*told, alone]):
        at = t.index("Zanzibarian")
        assert f"term:{at}:{at + 11}" in got[i][0] and got[i][1] == t.replace("Zanzibarian", "").replace("jo@ex.org", "[EMAIL]")
    assert all(got[i] == ("", t) for i, t in enumerate(plain, 6))


def test_pii_disclosures_by_hand(spark):
    """Every flagged term with its disclosure, against counts over distinct texts."""
    import math

    import regex

    rng = random.Random(6)
    people = [(f"p{k}@ex.org", f"Keeper{chr(65 + k) * 3}", f"Harbour{chr(65 + k) * 4}") for k in range(6)]
    common = [f"word{chr(97 + k)}" for k in range(20)]
    texts = []
    for i in range(400):
        said = rng.sample(common, 6)
        if i < 60:
            mail, name, place = people[i % 6]
            said += [mail] + ([name] if rng.random() < 0.97 else []) + ([place] if rng.random() < 0.6 else [])
            if i % 6 == 5:
                said.append(people[0][0])
        texts.append(" ".join(said) + f" no {i}")
    texts += texts[:40] + [None, ""]
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),)
    distinct = sorted({t or "" for t in texts})
    n, entity, term = len(distinct), {}, {}
    for k, t in enumerate(distinct):
        for kind, p in kinds:
            for m in re.finditer(p, t):
                entity.setdefault(f"{kind}:{m.group().lower()}", set()).add(k)
        for m in regex.findall(r"\p{L}{3,}", re.sub(r"\S*[@0-9]\S*", " ", t)):
            term.setdefault(m.lower(), set()).add(k)
    want = {}
    for e in entity.values():
        for w, held in term.items():
            both = len(e & held)
            if both >= 3 and len(e) >= 3 and len(held) >= 3 and len(e) < n:
                content = math.log(n / len(e))
                told = 1 - math.log(len(held) / both) / content
                if told >= 0.9 and both * content >= math.log(n * 1000):
                    want[w] = max(want.get(w, 0), told)
    assert 6 <= len(want) <= 15
    got = {r["term"]: r["disclosure"] for r in pii.flagged_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert set(got) == set(want) and all(got[w] == pytest.approx(want[w]) for w in want)


def test_pii_of_a_directory_page(spark):
    """Thousands of addresses and words in one text, in three copies that differ: spans and cleaning stay linear, pairs are of sets of texts."""
    import time

    def page(k, size):
        return " ".join(f"n{chr(97 + i % 26)}{i}@ex.org Family{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(size)) + f" copy {k}"

    seconds = []
    for size in (1000, 1000, 4000):
        df = spark.createDataFrame([(k, page(k, size)) for k in range(3)] + [(9 + k, f"other text {k}") for k in range(300)], "doc_id long, text string")
        began = time.time()
        got = pii.find(df).where("doc_id < 3").select(F.size("base_spans").alias("b"), F.size("spans").alias("s"), F.length(pii.clean(F.col("text"), F.col("spans"))).alias("n")).collect()
        seconds.append(time.time() - began)
        assert [r["b"] for r in got] == [size] * 3 and all(r["s"] >= 2 * size for r in got)
    assert seconds[2] < 6 * seconds[1]  # four times the addresses
