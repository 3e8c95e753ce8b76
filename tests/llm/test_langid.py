"""Languages: the registered query against a parse by hand, large alphabets, high planes, many languages, long texts."""

import random
import zlib

import numpy as np
import pytest

from quirefold.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def letters(text):
    out = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    while "  " in out:
        out = out.replace("  ", " ")
    return out


def parse(text, sample):
    """Phrases of the longest matches; an unknown letter is one of its own."""
    at = phrases = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(1, n - 1)
        phrases += 1
    return phrases


def by_hand(text, samples):
    t = letters(text)
    if not t.strip():
        return "und", 0.0
    h = []
    for lang in sorted(samples):
        s = letters(" ".join(x.lower() for x in samples[lang]))
        h.append((parse(t, s) * np.log2(max(2, len(s))) / len(t), lang))
    low = sorted(x for x, _ in h)
    return min(h)[1], low[1] / (low[0] + low[1]) if len(h) > 1 else 1.0


def sentence(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    rng = random.Random(12)
    tongues = {"aa": ["ka", "lo", "mi", "né"], "bb": ["sch", "ung", "er", "ka"], "cc": ["los", "ado", "er", "ía"]}
    out = [(i, sentence(rng, tongues[lang], rng.randint(3, 60)), lang, "s", None) for i in range(90) for lang in [rng.choice(list(tongues))]]
    out += [(100, None, "aa", "s", None), (101, "", "aa", "s", None), (102, " 12 \n!", None, "s", None), (103, "Ünknown ẞ İ", None, "s", None), (104, "É", "bb", "s", None)]
    out += [(200 + i, sentence(rng, tongues[lang], 1500), None, "s", None) for i, lang in enumerate(tongues)]  # long texts
    return out


def test_op7_by_hand(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learned = spark.createDataFrame([r for r in rows() if not held(r[0])], SCHEMA)
    samples = langid.sample(learned)
    assert {t for v in samples.values() for t in v} <= {r[1][:1000] for r in rows() if r[1] and r[2] and not held(r[0])}
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows())
    for i, text, *_ in rows():
        lang, score = by_hand(text, samples)
        assert (got[i]["held_out"], got[i]["lang_pred"]) == (held(i), lang) and got[i]["score"] == pytest.approx(score, abs=1e-9)


def test_a_long_text_is_parsed_as_one():
    rng = random.Random(3)
    samples = {"aa": [sentence(rng, ["ka", "lo", "mi"], 400)], "bb": [sentence(rng, ["ka", "lo", "er"], 400)]}
    model = langid.build(samples)
    texts = [sentence(rng, ["ka", "lo", "er", "mi", "q"], n) for n in (1, 30, 500, 3000)] + ["", samples["aa"][0] * 3]
    whole = langid.entropies(model, texts, segment=1 << 30)[0]
    for segment in (1, 7, 64, 1000):
        assert (langid.entropies(model, texts, segment=segment)[0] == whole).all()
    for t, h in zip(texts, whole, strict=True):
        if t:
            assert h[0] == pytest.approx(parse(letters(t), letters(samples["aa"][0])) * model.bits[0] / len(letters(t)))


@pytest.mark.parametrize("count", [100, 400, 6000])
def test_large_alphabets(count):
    """Two languages of letters of their own: no two letters are taken for each other."""
    rng = random.Random(4)
    own = {"aa": [chr(0x4E00 + i) for i in range(count)], "bb": [chr(0x4E00 + count + i) for i in range(count)]}
    text = lambda lang, n: "".join(rng.choice(own[lang]) for _ in range(n))
    model = langid.build({k: [text(k, 20000)] for k in own})
    h, _ = langid.entropies(model, [text("aa", 300), text("bb", 300)])
    assert h[0, 0] < 0.95 * h[0, 1] and h[1, 1] < 0.95 * h[1, 0]
    assert model.table.shape[1] <= 2 + 40 + 16 * 4
    codes = {tuple(langid._read(c, model.alphabet).tolist()) for k in own for c in own[k]}
    assert len(codes) >= len({c for k in own for c in own[k]} & {chr(p) for p in np.flatnonzero(model.alphabet.letters >= 2)})


def test_high_planes_and_many_languages(spark):
    """U+30000 is a letter; the 201st language can be told."""
    rng = random.Random(9)
    rows = [(i, chr(0x30000 + i) * 3 + " " + "".join(rng.choice("abc") for _ in range(20)), f"l{i:03d}") for i in range(260)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 260
    asked = spark.createDataFrame([(1, chr(0x30000 + 230) * 5), (2, chr(0x30000 + 900)), (3, "?")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    assert got[1][0] == "l230" and got[2][0] != "und" and got[3] == ("und", 0.0)
