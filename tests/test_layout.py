"""Page split, line merging and naming against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import naming as N
from quirefold.operators import converters, layout


def split(text, pages):
    words = text.split()
    if pages <= 1 or not words:
        return [text.strip()]
    rest, left, out, cur, size = sum(map(len, words)) + len(words) - 1, pages, [], [], 0
    for w in words:
        more = len(w) + bool(cur)
        if cur and size + more > rest / left and left > 1:
            out.append(" ".join(cur))
            rest, left, cur, size = rest - size, left - 1, [w], len(w)
        else:
            cur, size = [*cur, w], size + more
    out.append(" ".join(cur))
    return out + [""] * (pages - len(out))


def test_page_split(spark):
    rng = random.Random(3)
    cases = [(" a\nb ", 1), ("", 3), ("one", 3)] + [(" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 40))), rng.randint(1, 6)) for _ in range(80)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(cases)], "i int, t string, p int")
    for r in df.select("i", layout.split_pages(F.col("t"), F.col("p")).alias("c")).collect():
        assert r["c"] == split(*cases[r["i"]])


def over(a, b):
    shared, least = min(a[3], b[3]) - max(a[1], b[1]), min(a[3] - a[1], b[3] - b[1])
    return shared / least if shared > 0 and least > 0 else 0.0


def gap(a, b):
    return b[1] - a[3] if a[3] <= b[1] else a[1] - b[3] if b[3] <= a[1] else -1


def fold(boxes, joins):
    out = []
    for b in boxes:
        if out and joins(out[-1], b):
            a = out[-1]
            out[-1] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        else:
            out.append(b)
    return out


def merge(boxes, overlap=0.4, ratio=0.5, least=0.3):
    boxes = sorted(boxes, key=lambda b: (b[1], b[0]))
    if not boxes:
        return []
    h = sorted(b[3] - b[1] for b in boxes)
    ref = h[len(h) * 3 // 4] if len(h) >= 4 else h[len(h) // 2]
    kept = [b for b in boxes if b[3] - b[1] > int(ref * 0.2)]
    if not kept:
        return [max(boxes, key=lambda b: b[3] - b[1])]
    gaps = sorted(g for g in map(gap, kept, kept[1:]) if g >= 0)
    most = min(int(gaps[len(gaps) // 2] * 0.3), int(ref * ratio)) if gaps else int(ref * ratio)
    merged = fold(kept, lambda a, b: over(a, b) >= overlap or 0 <= gap(a, b) <= most)
    tall = [b for b in merged if b[3] - b[1] >= int(ref * least)]
    return sorted(tall or [max(merged, key=lambda b: b[3] - b[1])], key=lambda b: (b[1], b[0]))


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    out = [[], [(0, 0, 5, 0)], [(1, 2, 3, 40), (0, 2, 9, 40)]]
    for _ in range(150):
        page = []
        for line in range(rng.randint(1, 8)):
            for _ in range(rng.randint(1, 4)):
                y, x = line * rng.choice([20, 30, 45]) + rng.randint(-6, 6), rng.randint(0, 500)
                page.append((x, y, x + rng.randint(5, 90), y + rng.randint(0, 40)))
        out.append(page)
    return out


def test_line_merging(spark, pages):
    rows = [(i, [(b[1], b[0], k, b[2], b[3]) for k, b in enumerate(p)]) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, f"i int, boxes array<{layout.RAW}>")
    for r in layout.merge_lines(df, "boxes").collect():
        assert [tuple(b) for b in r["lines"]] == merge(pages[r["i"]]), pages[r["i"]]
    words = df.select("i", layout.merge_same_line(F.col("boxes"), F.lit(400)).alias("l"))
    for r in words.collect():
        kept = sorted((b for b in pages[r["i"]] if b[3] - b[1] >= 8), key=lambda b: (b[1], b[0]))
        assert [tuple(b) for b in r["l"]] == fold(kept, lambda a, b: over(a, b) >= 0.3)


def test_geometry(spark):
    one = spark.range(1)
    b = lambda *v: G.box(*map(F.lit, v))
    r = one.select(
        G.pad(b(3, 4, 50, 60), 10).alias("low"), G.pad(b(3, 4, 50, 60), 10, F.lit(55), F.lit(65)).alias("both"), G.scaled_size(F.lit(3000), F.lit(1000)).alias("big"), G.scaled_size(F.lit(100), F.lit(50)).alias("small"),
        G.from_relative(*map(F.lit, (0.1, 0.25, 0.999, 1.0)), F.lit(101), F.lit(10)).alias("px"), G.printed_part(b(1, 500, 2, 900), F.lit(1000)).alias("pp"), G.printed_part(F.lit(None).cast(G.BOX), F.lit(None).cast("int")).alias("no"),
    ).first()
    assert [tuple(r[k]) for k in ("low", "both", "big", "small", "px", "pp", "no")] == [(0, 0, 60, 70), (0, 0, 55, 65), (1280, 426), (100, 50), (10, 2, 100, 10), (0, 300, 1000, 480), (0, 300, 2479, 700)]


def test_names(spark):
    stems = {"Bullinger_print_eval_qwen_m1": ("bullinger_print", "qwen_m1"), "evaluation_m1_iam_print": ("iam_print", "m1"), "evaluation_qwen_m1": ("evaluation", "qwen_m1"), "evaluation_m1_0shot": ("0shot", "m1"), "x": ("x", "unknown"), "a_eval_b_eval_c": ("a", "b_eval_c")}
    df = spark.createDataFrame([(s,) for s in stems], "s string").select("s", N.result_file(F.col("s")).alias("n"))
    assert {r["s"]: tuple(r["n"]) for r in df.collect()} == stems
    models = {"OpenAI/gpt": ("openai", "gpt"), "a/b/c": ("hf", "a/b/c"), "plain": ("hf", "plain"), "hf/a/b": ("hf", "a/b")}
    df = spark.createDataFrame([(s,) for s in models], "s string").select("s", N.provider(F.col("s")).alias("n"))
    assert {r["s"]: tuple(r["n"]) for r in df.collect()} == models
    one = spark.range(1)
    assert one.select(N.checkpoint_name(F.lit("m2"), F.lit("d/iam"), F.lit("hf/a:b"), F.lit(2))).first()[0] == "checkpoint_m2_iam_hf_a_b_2shot.json"
    assert [r[0] for r in spark.createDataFrame([(7,), (1234,)], "i int").select(N.crop_name(F.lit("p"), F.col("i"))).collect()] == ["p_line007.png", "p_line1234.png"]
    import hashlib

    keys = [str(k) for k in range(60)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", N.hash_bucket(F.col("k")).alias("b"))
    assert all(r["b"] == int(hashlib.sha1(f"13:{r['k']}".encode()).hexdigest(), 16) % 1000 for r in df.collect())


def test_coded_lines(spark):
    cases = {
        "o-n-l-y|f-o-r|t-h-e-s_cm": "only for the,", "L-e-t|s_mi|m-e||s_pt": "Let- me .", "s_2-s_8th|s_zz|s_GW|u-n-l-e-s_s-s": "28th GW unless", "s_mi|a": "- a", "s_qt-s_sq-s_qo": "';:",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", N.decode_line(F.col("c")).alias("t"))
    assert {r["c"]: r["t"] for r in df.collect()} == cases
    rows = spark.createDataFrame([(0, "270-01 a-b|c"), (1, ""), (2, "lone"), (3, "271-01 d"), (4, "270-02 e")], "pos int, value string")
    got = {r["id"]: (r["gt"], r["transcription"]) for r in converters.convert_coded(rows).collect()}
    assert got == {"270": ("ab c\ne\n", "ab c e\n"), "271": ("d\n", "d\n")}


def test_many_boxes_are_folded_in_runs(spark):
    """Thousands of boxes of a page, of which pairs join; the order is kept and nothing is lost between runs."""
    boxes = [(i * 10, i, k, i + 5, i * 10 + 8) for i in range(3000) for k in (0, 1)]
    df = spark.createDataFrame([(boxes,)], f"boxes array<{layout.RAW}>")
    got = df.select(layout.merge_same_line(F.col("boxes"), F.lit(10)).alias("l")).first()["l"]
    assert [tuple(b) for b in got] == [(i, i * 10, i + 5, i * 10 + 8) for i in range(3000)]
    few = spark.createDataFrame([(boxes[:n],) for n in (0, 1, 126, 127, 128, 129)], f"boxes array<{layout.RAW}>")
    assert [r[0] for r in few.select(F.size(layout.merge_same_line(F.col("boxes"), F.lit(10)))).collect()] == [0, 1, 63, 64, 64, 65]
