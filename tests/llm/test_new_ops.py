"""License scan, prefix trie and phrase mining against brute force, with nulls, ties, repeated rows, clashing columns and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirefold.llm import license_scan, ordered, phrases, prefix_trie, queries

DOCS = "doc_id long, text string, lang string"


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- license scan


def scan_by_hand(text, percent=90):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text)) if w]
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    blocks = defaultdict(list)
    for t in license_scan.templates_of(license_scan.TEMPLATES, percent):
        for at in range(0, len(words), t.span):
            common = len(t.words & set(words[at : at + 2 * t.span]))
            if common >= t.least:
                blocks[t.span, at].append((t, common))
    found = [(t, n) for b in blocks.values() for t, n in b if not any(t.words < u.words for u, _ in b)]
    score = 1.0 if places else max([n / len(t.words) for t, n in found], default=0.0)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {t.label for t, _ in found})), round(score, 9))


def license_texts():
    rng = random.Random(3)
    pool = sorted({w for t in license_scan.templates_of(license_scan.TEMPLATES, 90) for w in t.words}) + ["lorem", "été", "x1"]
    noise = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    out = [None, "", " \n", "under the MIT license", "Under THE\nmit-license. Apache License, Version 2!", "under the Kit license", "under the mİt license"]
    for _, text in license_scan.TEMPLATES:
        words = text.split()
        out += [text, f"{noise(37)} {text.upper()} {noise(90)}", "\n".join(words), " ".join(words[: len(words) * 9 // 10]), " ".join(rng.sample(words, len(words)))]
    out += [noise(n) for n in (3, 15, 16, 17, 400, 30000)]
    return out


def test_license_scan(spark):
    texts = license_texts()
    rows = [(i if i % 5 else None, t, "en") for i, t in enumerate(texts)] + [(1, texts[9], "en")] * 3
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("words", F.lit("x"))
    got = sorted(((r[0], *r[1:7], round(r["score"], 9)) for r in license_scan.scan(docs).collect()), key=repr)
    assert got == sorted(((d, *scan_by_hand(t)) for d, t, _ in rows), key=repr)
    assert len({r[6] for r in got}) > 10


def test_license_blocks(spark):
    notice = dict(reversed(license_scan.TEMPLATES))["bsd"]
    rows = [(7, "word " * 200 + notice + " word" * 50, "en"), (8, "word " * 300, "en")]
    got = license_scan.find_blocks(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["doc_id"], r["label"]) for r in got} == {(7, "bsd")}
    assert all(r["score"] >= 0.9 for r in got) and any(r["first_word"] <= 200 and r["last_word"] >= 200 + len(notice.split()) - 1 for r in got)
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_license_templates_are_ascii():
    with pytest.raises(ValueError):
        license_scan.templates_of([("x", "été")], 90)


# --- prefix trie


def trie_by_hand(rows):
    said = lambda r, t: hashlib.sha256(f"{len(r or '')}:{r or ''}{t or ''}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", said(role, text), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, x in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = None if c is None else c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + x[h:]) if c is not None else tuple(x)
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    smallest = {n: min((c for c in m if c is not None), default=None) for n, m in members.items()}
    out = []
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted((c for c in m if len(rebuilt[c]) == len(node)), key=lambda c: -(2**63) if c is None else c)
        digest = hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.append((smallest[node], len(node), smallest[node[:-1]] if node else None, len(m), len(children[node]), sum(not children[n] for n in below), saved, digest))
    return sorted(out, key=repr)


def trie_rows():
    rng = random.Random(8)
    say = lambda: rng.choice(["", "hi", "ok", "été", None, "a\nb", "yes " * 9])
    out = []
    for c in [*range(0, 12), 100, 101, 103, 107, 177, 305, 306, -7, -105, None]:
        out += [(c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), say()) for t in range(rng.randint(1, 7))]
    out += [(9, 3, "user", "again")] * 4  # repeated rows
    out += [(500 + i, t, "user", f"same {t}") for i in range(40) for t in range(5)]  # one conversation many times
    out += [(900, t, "user", f"long {t // 2}") for t in range(300)] + [(1000, t, "user", f"long {t // 2}") for t in range(200)]
    return out


def run_trie(spark, rows, path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0)).withColumn("n", F.lit(1)).write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.op12_prefix_trie(spark, str(path)).collect()), key=repr)


def test_prefix_trie(spark, tmp_path, monkeypatch):
    whole = ordered.in_parts
    monkeypatch.setattr(prefix_trie, "in_parts", lambda df, order, tag, rows: whole(df, order, tag, rows, per_part=50))  # ranges cut long conversations
    assert run_trie(spark, trie_rows(), tmp_path) == trie_by_hand(trie_rows())


def test_prefix_trie_of_nothing(spark, tmp_path):
    assert run_trie(spark, [], tmp_path) == []


def test_preorder_intervals(spark, tmp_path):
    rows = [(c, t, "user", str(x)) for c, way in enumerate(["abc", "abd", "ab", "xy", "abce"]) for t, x in enumerate(way)]
    turns, convs = prefix_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    trie = prefix_trie.build(*prefix_trie.splice(turns, convs, F.col("c"), F.lit(0), most=5))
    nodes = trie.nodes.orderBy("preorder").collect()
    assert [r["preorder"] for r in nodes] == list(range(1, 9))
    for r in nodes:
        inside = [x for x in nodes if r["preorder"] <= x["preorder"] <= r["subtree_end"]]
        assert all(x["depth"] > r["depth"] for x in inside if x is not r) and sum(x["n_children"] == 0 for x in inside) == r["n_leaves"]
        after = [x["depth"] for x in nodes if x["preorder"] == r["subtree_end"] + 1]
        assert not after or after[0] <= r["depth"]


# --- phrases


def phrases_by_hand(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        held = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        kept = []
        for p, a in held.items():
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in held.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(4)
    words = ["the", "Of", "été", "Été", "a-b", " ", "x", "y", "z", "over\x00all"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "! "]) for _ in range(n))
    out = [(i, text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und", ""])) for i in range(60)]
    out += [(None, None, "en"), (1, "", None), (2, " .,\n", "en"), (3, text(4000), "en"), (4, "new york city", "de")]
    return out + [(5, "one of the same words again. and the end", "en")] * 50


@pytest.mark.parametrize("longest,block", [(5, 6 << 20), (3, 200), (2, 200)])
def test_phrases(spark, longest, block):
    docs = spark.createDataFrame(phrase_rows(), DOCS).withColumn("phrase", F.lit(1)).withColumn("block", F.lit(1))
    got = phrases.mine(docs, min_count=5, longest=longest, top=40, block_bytes=block)
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_hand(phrase_rows(), 5, longest, 40)


def test_crowded_sketch_loses_nothing(spark):
    """Hundreds of phrases to a counter: all survive the first pass, and the second one counts them exactly."""
    docs = spark.createDataFrame(phrase_rows(), DOCS)
    tight = phrases.count_phrases(docs, 300, 5, load=1 << 40)
    counts = {(r["lang"], r["phrase"]): r["f"] for r in tight.where("n_words > 0").collect()}
    by_hand = Counter()
    for _, text, lang in phrase_rows():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            by_hand.update(("und" if lang is None else lang, " ".join(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    assert counts == {k: c for k, c in by_hand.items() if c >= 300} and counts


def test_scores_beyond_64_bits(spark):
    """1000 a n and l r pass 64 bits: the quotient stays exact."""
    a, n, l, r = 3_000_000_019, 8_000_000_000_037, 3_000_000_021, 7_000_000_011
    rows = spark.createDataFrame([("en", 0, "", n), ("en", 1, "p", l), ("en", 1, "q", r), ("en", 2, "p q", a)], phrases.COUNTS)
    assert phrases.scored(rows, 5).first()["score"] == 1000 * a * n // (l * r)


def test_phrases_of_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, None, None), (2, "", "en")], DOCS)).count() == 0
