"""The registered queries over a small table, against brute force from texts alone."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import queries
from tests.llm.test_corpus_ops import brute_components, lm, near_copies, water, words
from tests.llm.test_text_ops import PII, base_spans, shingles

NONE = -10


@pytest.fixture(scope="module")
def table(spark, all_rows, tmp_path_factory):
    """Rows with distinct ids, near copies and personal data, and their folder."""
    rows = [(i if i is not None else 3000 + k, *r) for k, (i, *r) in enumerate(all_rows) if (i, *r) not in all_rows[:k]]
    rows += [(1000 + i, t, "en", "s1", None) for i, t in near_copies()]
    rows += [(2000 + i, t, "en", "s2", None) for i, t in enumerate(PII)]
    rows.append((2100, "<|endoftext|> plain <|startoftext|> é\x85 two  spaces\n\n end", "en", "s2", None))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return sorted(rows), folder


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_op1_exact_columns(spark, table):
    rows, folder = table
    got = by_id(queries.op1_lm_score(spark, folder))
    tok, c1, n, v, p = lm(rows)
    assert set(got) == {r[0] for r in rows}
    for i, t, *_ in rows:
        s, r = tok(t), got[i]
        base = sum(np.log10((c1[z] + 0.1) / (n + 0.1 * (v + 1))) for z in s)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc_mod(i, 10) == 0, len(s), sum(c1[z] > 0 for z in s), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        model = sum(np.log10(p(a, b, z)) for a, b, z in zip(["<", "<", *s], ["<", *s], s, strict=False))
        assert r["score"] == pytest.approx(model, rel=0.03, abs=0.05)


def test_op3_components(spark, table):
    rows, folder = table
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op3_jaccard_join(spark, folder).collect())
    assert got == brute_components(rows, 90, 3)


def test_op4_edited_texts(spark, table):
    rows, folder = table
    got = by_id(queries.op4_fingerprints(spark, folder))
    texts = [t or "" for _, t, *_ in rows]
    prints = {}
    for k, (i, *_) in enumerate(rows):
        text, after, r = texts[k], texts[(k + 1) % len(texts)], got[i]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = shingles(text), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - exact) <= (1e-12 if max(len(a), len(b)) < 128 else 0.15)


def library(path, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_op5_ids(spark, table, vocabularies):
    rows, folder = table
    got, at = by_id(queries.op5_id_store(spark, folder)), 0
    encode = library(vocabularies["word_bpe_49k.json"], 2)
    for i, t, *_ in rows:
        ids = encode(t)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op6_words(spark, table):
    rows, folder = table
    got = by_id(queries.op6_mix_sources(spark, folder))
    sizes, taken = Counter(), Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    target = water(sizes)
    for i, t, _, s, _ in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (len(words(t)), sizes[s]) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_op7_rows(spark, table):
    rows, folder = table
    got = by_id(queries.op7_language_id(spark, folder))
    learnt = {lang for i, t, lang, *_ in rows if lang and t and crc_mod(i, 3) != 1}
    for i, t, *_ in rows:
        r, lettered = got[i], any(c.isalpha() for c in t or "")
        assert r["held_out"] == (crc_mod(i, 3) == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learnt if lettered else r["lang_pred"] == "und"


def test_op8_counts_and_digests(spark, table):
    rows, folder = table
    got = by_id(queries.op8_pii(spark, folder))
    for i, t, *_ in rows:
        r, base = got[i], base_spans(t)
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if s and not s.startswith("term:")) == base


def check_pieces(pieces, texts, encode):
    """Pieces cover each document's ids once; sequences have no gaps and little padding."""
    wanted, parts, sequences = {i: encode(t) for i, t in texts}, {}, {}
    for r in pieces:
        ids = wanted[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for runs, most in [*((parts[i], len(ids)) for i, ids in wanted.items()), *((s, 2048) for s in sequences.values())]:
        at = 0
        for start, length in sorted(runs):
            assert start == at and length > 0
            at += length
        assert at == most or most == 2048 and at <= 2048
    return sequences


def test_op10_pieces(spark, table, vocabularies):
    rows, folder = table
    sequences = check_pieces(queries.op10_pack(spark, folder).collect(), [(i, t) for i, t, *_ in rows], library(vocabularies["byte_bpe_50k.json"], 1))
    empty = Counter()
    for k, s in sequences.items():
        empty[k >> 33] += 2048 - sum(n for _, n in s)
    assert len(empty) <= 8 and max(empty.values()) < 2048  # by partition; one group in each


def test_pipeline_run(spark, table, vocabularies):
    """run() is its stages; a lazy result of another query outlives it; each stage's texts against brute force."""
    import corpus_pipeline as cp
    from quirefold.llm import mixing, pii

    rows, folder = table
    lazy = queries.op3_jaccard_join(spark, folder)
    out = cp.run(spark, folder).collect()
    assert lazy.count() == len(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.near_copies(spark, cp.language(spark, docs, folder), folder)  # lazy, like the one made of it below
    alike = {i: c for i, _, c in brute_components([r for r in rows if any(c.isalpha() for c in r[1] or "")], 80, 5)}
    assert {r["doc_id"] for r in kept.collect()} == set(alike.values())
    told = pii.find(kept).select("doc_id", "text", pii.span_list(F.col("spans")).alias("s")).collect()
    clean = cp.personal_data(spark, kept, folder)
    texts = {r["doc_id"]: r for r in clean.collect()}
    for r in told:
        want, at = [], 0
        for kind, a, b in (x.split(":") for x in r["s"].split(",") if x):
            if int(a) >= at:
                want += [r["text"][at : int(a)], "" if kind == "term" else f"[{kind.upper()}]"]
            at = max(at, int(b))
        assert texts[r["doc_id"]]["text"] == "".join(want) + r["text"][at:]
        assert not base_spans(texts[r["doc_id"]]["text"]) or "," in r["s"]
    mixed = {r["doc_id"]: r for r in cp.mixture(spark, clean, folder).collect()}
    plan = {r["doc_id"]: r for r in mixing.mix(cp._keyed(clean).select(F.col("_row").alias("doc_id"), "text", "source")).select(F.col("doc_id"), "taken").collect()}
    hashed = {r["doc_id"]: r["h"] for r in cp._keyed(clean).select("doc_id", F.col("_row").alias("h")).collect()}
    for i, r in texts.items():
        taken, size = plan[hashed[i]]["taken"], len(words(r["text"]))
        assert (i in mixed) == (taken > 0)
        if taken:
            got = words(mixed[i]["text"])
            assert len(got) == taken and mixed[i]["n_chars"] == len(mixed[i]["text"])
            assert not Counter(got) - Counter(words(r["text"]) * 2) and (taken < size or mixed[i]["text"].startswith(r["text"]))
    check_pieces(out, [(i, r["text"]) for i, r in mixed.items()], library(vocabularies["byte_bpe_50k.json"], 1))


def test_clashing_columns(spark, table):
    """Input columns named like inner or output columns, in any case of letters."""
    from quirefold.llm import fingerprints, hamming, langid, mixing, ngram_lm, packing, pii

    rows, folder = table
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(5)
    more = docs
    for c in ("term_spans", "text_key", "_terms", "terms", "row", "clean_text", "spans", "base_spans", "block", "held_out", "shard", "quota", "_draw", "sketch", "_bucket", "_key", "label", "score", "lang_pred", "ids", "part", "weird.name"):
        more = more.withColumn(c, F.lit("clash"))
    found = pii.find(more)
    assert found.count() == 5 and {"term_spans", "text_key", "_terms", "terms", "row", "clean_text", "weird.name"} <= set(found.columns)
    assert found.where("text_key = 'clash' and clean_text = 'clash'").count() == 5
    assert ngram_lm.score_documents(more).count() == mixing.mix(more).count() == fingerprints.with_neighbour(more).count() == 5
    assert langid.predict(more, langid.fit(more)).count() == 5
    assert packing.pack(more, __import__("public_tokenizers").path("byte_bpe_50k.json")).count() >= 5
    v = spark.createDataFrame([(k, [float((k * j) % 7 - 3) for j in range(20)]) for k in range(30)], "vec_id long, embedding array<double>").withColumn("code", F.lit("clash"))
    got = hamming.nearest(v, "vec_id", hamming.sign_code(F.col("embedding")), F.col("vec_id") % 10 == 0, k=3, index_block=7)
    bits = {r["vec_id"]: [x > 0 for x in r["embedding"]] for r in v.collect()}
    for q in (0, 10, 20):
        want = sorted((sum(a != b for a, b in zip(bits[q], bits[i], strict=True)), i) for i in bits if i != q)[:3]
        assert [(r["distance"], r["neighbour_id"]) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want
    long = spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="more dimensions"):
        hamming.nearest(long, "vec_id", hamming.sign_code(F.col("embedding")), F.lit(True)).collect()
