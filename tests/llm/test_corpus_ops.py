"""Language model, language ID, Jaccard join, mixing, Hamming search and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import grams, hamming, jaccard_join, langid, mixing, ngram_lm
from quirefold.llm.components import components
from quirefold.llm.elias_fano import EliasFano, TrieShard, WordShard


def words(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def test_elias_fano_and_trie():
    rng = np.random.default_rng(2)
    for n, u in ((0, 10), (1, 1), (1000, 1 << 40), (500, 600), (3000, 1 << 20), (4000, 50)):
        v = np.sort(rng.integers(0, u, n).astype(np.uint64))
        e = EliasFano.encode(v, u)
        assert (e.get(np.arange(n)) == v).all()
        q = np.r_[rng.integers(0, u, 50).astype(np.uint64), v[:50]]
        at, hit = e.successor(q)
        assert (at == np.searchsorted(v, q)).all() and (hit == np.isin(q, v)).all()
        begin = rng.integers(0, n + 1, len(q))
        end = np.minimum(n, begin + rng.integers(0, 30, len(q)))
        at, hit = e.successor(q, begin, end)
        for k, x in enumerate(q):
            part = v[begin[k] : end[k]]
            assert at[k] == begin[k] + np.searchsorted(part, x) and hit[k] == (x in part)
    assert EliasFano.encode(np.arange(10000, dtype=np.uint64) * np.uint64(64), 640000).size_in_bytes() < 10000 * 1.3
    contexts, starts, follow = np.array([5, 9, 1 << 35], np.uint64), np.array([0, 2, 3]), np.array([1, 7, 7, 2, 3], np.uint64)
    t = TrieShard(contexts, starts, follow, np.array([10, 20, 30], np.uint8), np.array([1, 2, 3], np.uint8), np.array([1, 2, 3, 4, 5], np.uint8))
    prob, backoff, count = t.look_up(np.array([5, 5, 6, 9, 9, 1 << 35], np.uint64), np.array([7, 2, 7, 7, 1, 3], np.uint64))
    assert prob.tolist() == [2, 0, 0, 3, 0, 5] and backoff.tolist() == [10, 10, 0, 20, 20, 30] and count.tolist() == [1, 1, 0, 2, 2, 3]
    w = WordShard(np.array([3, 8, 1 << 47], np.uint64), np.array([4, 1, 10**6]))
    assert w.look_up(np.array([8, 0, 1 << 47, 3, 4], np.uint64)).tolist() == [1, 0, 10**6, 4, 0]
    assert WordShard(np.zeros(0, np.uint64), np.zeros(0, np.int64)).look_up(np.array([1], np.uint64)).tolist() == [0]


def test_words_are_hashed_alike_in_any_run():
    rng = random.Random(1)
    texts = [None, "", "  ", "A b", "a B c", "İx ß y", "  lead", "tail \n", "x" * 300, None]
    texts += ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "xyz ", "\u00a0"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for run in (1 << 20, 7, 64):
        seen = {}
        for part in (pa.array(texts), pa.array(texts).slice(3, 100), pa.array(texts[:0])):
            h, edges = grams.hashed_words(part, run)
            split = [(t or "").encode().lower().split() for t in part.to_pylist()]
            assert np.diff(edges).tolist() == [len(x) for x in split]
            for w, v in zip([w for x in split for w in x], h.tolist(), strict=True):
                assert seen.setdefault(w, v) == v
        assert len(set(seen.values())) == len(seen)


def lm(rows, discount=0.8, weight=0.2):
    tok = lambda t: words(t) + ["</s>"]
    c1, c2, c3, kinds = Counter(), Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0:
            continue
        c1.update(tok(t))
        s = ["<", "<", *tok(t), ">"]
        for a, b, z in zip(s, s[1:], s[2:], strict=False):
            kinds[a, b] += (a, b, z) not in c3
            c3[a, b, z] += 1
            c2[a, b] += 1
    n, v = sum(c1.values()), len(c1)

    def p(x, y, z):
        p1 = (c1[z] + 0.1) / (n + 0.1 * (v + 1))
        before = c1["</s>"] if y == "<" else c1[y]
        p2 = weight * c2[y, z] / before + (1 - weight) * p1 if before else p1
        k = c2[x, y]
        return (max(c3[x, y, z] - discount, 0) + discount * kinds[x, y] * p2) / k if k else p2

    return tok, c1, n, v, p


def test_language_model(docs, empty, all_rows):
    small = ngram_lm.score(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0, block_bytes=3000, shard_tokens=700)
    tok, c1, n, v, p = lm(all_rows)
    want = {}
    for i, t, *_ in all_rows:
        s = tok(t)
        base = sum(np.log10((c1[z] + 0.1) / (n + 0.1 * (v + 1))) for z in s)
        score = sum(np.log10(p(a, b, z)) for a, b, z in zip(["<", "<", *s], ["<", *s], s, strict=False))
        want.setdefault((i, len(s), sum(c1[z] > 0 for z in s)), []).append((base, score))
    got = small.collect()
    assert len(got) == len(all_rows)
    for r in got:
        base, score = want[r["doc_id"], r["n_tokens"], r["n_known"]][0]
        assert r["train_tokens"] == n and abs(r["base_score"] - base) < 1e-6
        assert abs(r["score"] - score) < 0.03 * abs(score) + 0.05
    assert ngram_lm.score_documents(empty).count() == 0
    context = ("the", words(all_rows[0][1])[0])
    assert abs(sum(p(*context, z) for z in [*c1, "?"]) - 1) < 1e-9


def test_grams_pack():
    rng = np.random.default_rng(1)
    for width in (5, 6, 8):
        v = np.sort(rng.integers(0, (1 << 8 * width) - 1, 500, dtype=np.uint64))
        assert (grams.unpack(grams.pack(v, width), width) == v).all()
    shard = rng.integers(0, 9, 500)
    assert (grams.sort_order(v, shard) == np.lexsort((v, shard))).all()
    m = rng.integers(0, 255, (40, 3)).astype(np.uint8)
    assert (grams.expand(grams.squeeze(m), "u1", 3) == m).all() and (grams.expand(grams.squeeze(v), "<u8") == v).all()
    c = np.array([0, 1, 127, 128, 5000, 10**9])
    assert np.abs(grams.COUNT_OF[grams.count_code(c)] / np.maximum(c, 1) - (c > 0)).max() < 0.08


def brute_components(rows, percent, width):
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            f = find(k)
            least[f] = min(least.get(f, r[0]), r[0])
    return sorted(((r[0] if r[0] is not None else -1), len(s), (-1 if (m := least.get(find(k))) is None else m)) for k, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_copies():
    """Chains of small changes, so that ends of a chain do not link, and sizes that differ."""
    rng = random.Random(8)
    out = []
    for g in range(6):
        text = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([40, 70, 150]))]
        for _ in range(15):
            out.append((len(out), " ".join(text)))
            for _ in range(rng.choice([1, 1, 2, 3])):
                k = rng.randrange(len(text))
                if rng.random() < 0.3:
                    text.insert(k, f"n{rng.randint(0, 10**6)}")
                else:
                    text[k] = f"n{rng.randint(0, 10**6)}"
    return out


@pytest.mark.parametrize("percent,chunk,few", [(90, 1000, 32), (80, 4, 1), (80, 4, 5), (90, 2, 1000)])
def test_jaccard_join(spark, docs, empty, all_rows, percent, chunk, few):
    more = [(i + 500, t, None, None, None) for i, t in near_copies()]
    rows = [*all_rows, *more]
    df = docs.drop("extra").unionByName(spark.createDataFrame(more, docs.drop("extra").schema))
    got = jaccard_join.join_components(df.withColumn("label", F.lit("clash")), percent=percent, chunk=chunk, few=few, block_bytes=4000, shard_tokens=500)
    mine = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got.collect())
    assert mine == brute_components(rows, percent, 3)
    assert jaccard_join.join_components(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("b", "a"), ("c", "a"), ("z", "z")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len({got[f"{k:03d}"] for k in range(41)}) == 1 and got["a"] == got["b"] == got["c"] and got["a"] != got["000"] and "z" not in got


def water(sizes, budget=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, budget * sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(docs, empty, all_rows):
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in all_rows:
        sizes[r[3]] += n_words(r[1])
    out = mixing.mix(docs.withColumn("quota", F.lit("clash")), block_words=16, shard_words=300)
    got = out.collect()
    assert len(got) == len(all_rows)
    target, taken = water(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    key = lambda r: (str(r["doc_id"]), r["size"], r["first_word"], r["taken"])
    again = mixing.mix(docs.repartition(5), block_words=16, shard_words=300).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    counted = out.select("taken", F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0))), lambda w: mixing.copies_of_word(w)), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), "size")
    assert all(r["taken"] == r["n"] for r in counted.where("size > 0").collect())
    assert mixing.mix(empty).count() == 0


def test_mixing_small_sources_and_caps(spark):
    """Sources of one document, at the block size of production: a target at the cap, and targets below a block."""
    for sizes in ({"s0": 1280, "s1": 1025, "s2": 256, "s3": 640, "s4": 1280}, {"a": 30, "b": 50, "c": 130, "d": 9000}, {"a": 1}, {"a": 0, "b": 7}):
        rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes.items())]
        target = water(sizes)
        for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
            assert r["taken"] <= 2 * r["size"] and abs(r["taken"] - target[r["source"]]) <= 0.5 + 1e-9, (sizes, r)


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(4)
    votes = {f"p{k}": rng.choice([0, 1, 5, 40, 1000, rng.randint(1, 500)]) for k in range(12)}
    for seats in (0, 1, 7, 50, 333):
        df = spark.createDataFrame([(k, float(v), seats) for k, v in votes.items()], "party string, votes double, seats long")
        got = {r["party"]: r["quota"] for r in mixing.sainte_lague(df, [], "party", "votes", "seats").collect()}
        have = dict.fromkeys(votes, 0)
        for _ in range(seats):
            have[max(votes, key=lambda k: votes[k] / (2 * have[k] + 1))] += 1
        quotient = sorted(votes[k] / (2 * s + 1) for k, n in got.items() for s in range(n))
        assert sum(got.values()) == seats and quotient == pytest.approx(sorted(votes[k] / (2 * s + 1) for k, n in have.items() for s in range(n)))


def phrases(text, train):
    count, k = 0, 0
    while k < len(text):
        n = 0
        while k + n < len(text) and text[k : k + n + 1] in train:
            n += 1
        k, count = k + max(n, 1), count + 1
    return count


def test_cross_parsing_counts_phrases():
    train = {"x": ["abcabcabd the quick"], "y": ["zzyzx die schnelle"]}
    model = langid.build(train)
    texts = ["abcabd qui", "zyzzx schne", "1 2 3", "", "abcabc\n\nabcabd"]
    h, lettered = langid.entropies(model, texts, segment=1000)
    assert lettered.tolist() == [True, True, False, False, True]
    norm = lambda t: re.sub("[^a-z]+", " ", t)
    for i, t in enumerate(texts):
        if t:
            for j, k in enumerate("xy"):
                n = len(train[k][0])
                assert h[i, j] == pytest.approx(phrases(norm(t), train[k][0]) * np.log2(n) / len(norm(t)))


def test_language_id(spark, empty):
    rng = random.Random(1)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(60))
    parts = {"aa": ["the", "ing", "wh", "ou"], "bb": ["sch", "ein", "ü", "keit"]}
    rows = [(i, make(parts[k := ("aa", "bb")[i % 2]]), k if i % 5 else None, "s") for i in range(120)] + [(900, None, "aa", "s"), (901, "12 34", "bb", "s"), (902, "", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == ("aa", "bb")[i % 2] and 0.5 <= got[i]["score"] <= 1 for i in range(120))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert langid.predict(empty, model).count() == 0
    none = langid.predict(df, langid.fit(df.where("false"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_hamming_search(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 64))
    v[50:80] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (None, v[3].tolist()), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hamming.nearest(df, "vec_id", hamming.sign_code(F.col("embedding")), F.col("vec_id") % 50 == 0, k=5, index_block=90, query_block=3)
    bits = v > 0
    want = []
    for q in range(0, 300, 50):
        d = sorted(((bits[q] != bits[i]).sum(), i) for i in range(300) if i != q)[:5]
        want += [(q, i, int(x), k + 1) for k, (x, i) in enumerate(d)]
    assert sorted(tuple(r) for r in got.select("query_id", "neighbour_id", "distance", "rank").collect()) == sorted(want)
    assert hamming.nearest(df.limit(0), "vec_id", hamming.sign_code(F.col("embedding")), F.lit(True)).count() == 0


@pytest.mark.parametrize("segments", [4, 8])
def test_hamming_search_of_many_queries_together(segments, monkeypatch):
    """All distances by hand: near and far codes, ties, fewer codes than asked for, bounds, steps of few codes."""
    monkeypatch.setattr(hamming, "_HITS", 50)
    rng = np.random.default_rng(segments)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, base[:20] ^ np.uint64(5), base[:20] ^ np.uint64(1 << 40), rng.integers(0, 64, 30, dtype=np.uint64)]))
    firsts = rng.permutation(len(codes)).astype(np.int64)
    asked = np.concatenate([codes[::9], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])
    for held, k in ((codes, 6), (codes[:4], 6), (codes[:1], 1)):
        index = hamming.MultiIndex(held, firsts[: len(held)], segments)
        for bounds in (None, np.arange(len(asked)) % 30):
            q, at, distance = index.search(asked, k, bounds)
            got = list(zip(q.tolist(), distance.tolist(), firsts[at].tolist(), strict=True))
            want = []
            for j, x in enumerate(asked.tolist()):
                d = sorted((bin(x ^ c).count("1"), int(firsts[i])) for i, c in enumerate(held.tolist()))[:k]
                want += [(j, a, f) for a, f in d if bounds is None or a <= bounds[j]]
            assert got == want


def test_hamming_exchange_is_linear(spark, monkeypatch):
    """The index is exchanged once for every group of queries; queries once a block."""
    sent, met_of = [], hamming._blocks_met

    def counting(*args):
        met = met_of(*args)
        sent.append({r["kind"]: r["n"] for r in met.groupBy("kind").agg(F.sum(F.size("codes")).alias("n")).collect()})
        return met

    monkeypatch.setattr(hamming, "_blocks_met", counting)
    rng = np.random.default_rng(3)
    for n in (2000, 4000):
        df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(0, 1 << 62, n))], "vec_id long, code long")
        hamming.nearest(df, "vec_id", F.col("code"), F.col("vec_id") % 100 == 0, k=3, index_block=500).count()
    assert [s[0] for s in sent] == [2000, 4000] and sent[1][1] == 8 * 40


def test_pipeline_stages(spark, docs, empty, all_rows):
    import corpus_pipeline as cp

    before = docs.drop("extra")
    lang = cp.language(spark, before, "")
    assert {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in lang.collect()} == {103, 104, 105}
    kept = cp.near_copies(spark, before, "").collect()
    want = brute_components(all_rows, 90, 3)
    assert len(kept) == len({c for i, n, c in want if c != -1 and n}) + sum(1 for i, n, c in want if c == -1 or not n)
    mixed = cp.mixture(spark, before, "").collect()
    sizes = {r["doc_id"]: r for r in mixed}
    plan = Counter()
    for r in mixed:
        plan[r["source"]] += len(words(r["text"]))
    assert sizes and all(c in mixed[0].asDict() for c in cp.COLUMNS) and sum(plan.values()) == pytest.approx(1.5 * sum(len(words(t)) for _, t, *_ in all_rows), rel=0.15)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, "").columns == cp.COLUMNS and stage(spark, empty, "").count() == 0
    assert cp.packed(spark, before, "").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_overlapping_paragraphs_make_pairs_in_proportion(spark, monkeypatch):
    """Documents of ten paragraphs that share nine with the next: one tied set of all, few pairs each, no links."""
    paragraph = lambda k: " ".join(f"p{k}w{j}" for j in range(12))
    counted, pairs_of = [], jaccard_join.group_pairs

    def counting(held, hot, percent):
        pairs = pairs_of(held, hot, percent).cache()
        counted.append((pairs.count(), hot.count()))
        return pairs

    monkeypatch.setattr(jaccard_join, "group_pairs", counting)
    for n in (150, 300):
        df = spark.createDataFrame([(i, " ".join(paragraph(i + k) for k in range(10)), None, None, None) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
        got = jaccard_join.join_components(df, chunk=50, few=32).collect()
        assert sorted(r["component_id"] for r in got) == list(range(n))
    assert all(hot == 0 for _, hot in counted)
    assert counted[1][0] <= 2.2 * counted[0][0] and counted[1][0] <= 20 * 300
