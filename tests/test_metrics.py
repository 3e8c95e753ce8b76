"""Metrics against plain Python restatements and the known cases of exact-line scores."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import metrics as M
from quirefold.functions import text as X
from quirefold.operators import evaluate

# (gt, prediction, precision, recall, f1)
ARRAYS = {
    "line_break_variation": (["Hello there,", "thank you for your", "detailed response."], ["Hello there,", "thank you", "for your", "detailed response."], 0.5, 2 / 3, 0.571),
    "duplicate_lines": (["a", "a", "b"], ["a", "b", "b"], 2 / 3, 2 / 3, 2 / 3),
    "empty_pred": (["x"], [], 0, 0, 0),
    "empty_gt": ([], ["x"], 0, 0, 0),
    "both_empty": ([], [], 0, 0, 0),
    "perfect": (["a", "b", "c"], ["a", "b", "c"], 1, 1, 1),
    "reordered": (["a", "b", "c"], ["c", "a", "b"], 1, 1, 1),
    "no_matches": (["a", "b", "c"], ["x", "y", "z"], 0, 0, 0),
    "multiple_duplicates": (["a", "a", "a", "b"], ["a", "a", "b", "b"], 0.75, 0.75, 0.75),
    "more_pred": (["a", "b"], ["a", "b", "c", "d"], 0.5, 1, 2 / 3),
    "more_gt": (["a", "b", "c", "d"], ["a", "b"], 1, 0.5, 2 / 3),
    "single_match": (["x"], ["x"], 1, 1, 1),
    "single_mismatch": (["x"], ["y"], 0, 0, 0),
    "case": (["Hello"], ["hello"], 0, 0, 0),
    "punctuation": (["Hello."], ["Hello"], 0, 0, 0),
}
# (gt, prediction, normalized, precision, recall, f1 or None)
TEXTS = {
    "basic": ("Hello there,\nthank you for your\ndetailed response.", "Hello there,\nthank you\nfor your\ndetailed response.", False, 0.5, 2 / 3, 0.571),
    "trailing": ("  a  \n b \n", "a\nb", False, 1, 1, 1),
    "inner_spaces_raw": ("a  b\nc", "a b\nd", False, 0, 0, 0),
    "inner_spaces_norm": ("a  b\nc  d", "a b\nc d", True, 1, 1, 1),
    "inner_blank": ("line1\n\nline2\n", "line1\nline2", False, 1, 2 / 3, None),
    "empty": ("", "", False, 0, 0, 0),
    "white_space": (" \n\t ", "  ", False, 0, 0, 0),
}


def test_exact_lines_of_arrays(spark):
    df = spark.createDataFrame([(k, g, p) for k, (g, p, *_) in ARRAYS.items()], "k string, g array<string>, p array<string>")
    p, r, f1 = M.exact_line_prf(F.col("g"), F.col("p"))
    for row in df.select("k", p.alias("p_"), r.alias("r_"), f1.alias("f_")).collect():
        assert (row["p_"], row["r_"], row["f_"]) == pytest.approx(ARRAYS[row["k"]][2:], abs=0.001), row["k"]


def test_exact_lines_of_texts(spark):
    for normalized in (False, True):
        cases = {k: v for k, v in TEXTS.items() if v[2] == normalized}
        df = spark.createDataFrame([(k, v[0], v[1]) for k, v in cases.items()], "k string, g string, p string")
        p, r, f1 = M.exact_line_prf_text(F.col("g"), F.col("p"), normalized)
        for row in df.select("k", p.alias("p_"), r.alias("r_"), f1.alias("f_")).collect():
            want = cases[row["k"]][3:]
            assert (row["p_"], row["r_"]) == pytest.approx(want[:2], abs=0.001)
            assert want[2] is None or row["f_"] == pytest.approx(want[2], abs=0.001)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def rate(a, b):
    return (float(bool(b))) if not a else distance(a, b) / len(a)


def lines(t):
    return [x.strip() for x in t.strip().splitlines()] if t.strip() else []


def accuracy(a, b):
    if not a:
        return float(not b)
    n = max(len(a), len(b))
    pad = lambda x: x + [""] * (n - len(x))
    return sum(x == y for x, y in zip(pad(a), pad(b), strict=True)) / n


def random_pairs():
    rng = random.Random(2)
    alphabet = ["ab", "ä", "x y", " ", "\n", "\n\n", " ", " ", "\x1c", "word", "😀", "\r\n", "\t"]
    text = lambda: "".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))
    return [("", ""), ("", "a"), ("a", ""), (" ", "\n")] + [(text(), text()) for _ in range(120)]


def test_rows_match_restatement(spark):
    pairs = random_pairs()
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pairs)], "id string, gt string, prediction string")
    norm = lambda t: " ".join(t.split())
    for row in evaluate.evaluation_rows(df).collect():
        a, b = pairs[int(row["id"])]
        la, lb = lines(a), lines(b)
        want = {
            "len_gt": len(a), "len_pred": len(b), "wer": rate(a.split(), b.split()), "wer_norm": rate(a.split(), b.split()), "cer": rate(a.strip(), b.strip()), "cer_norm": rate(norm(a), norm(b)),
            "line_acc": accuracy(la, lb), "rev_line_acc": accuracy(la[::-1], lb[::-1]), "line_acc_norm": accuracy([norm(x) for x in la], [norm(x) for x in lb]),
        }
        for k, v in want.items():
            assert row[k] == pytest.approx(v), (k, a, b)


def test_swapping_sides_swaps_precision_and_recall(spark):
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(random_pairs())], "id string, gt string, prediction string")
    one = {r["id"]: r for r in evaluate.evaluation_rows(df).collect()}
    two = {r["id"]: r for r in evaluate.evaluation_rows(df, "prediction", "gt").collect()}
    assert all(one[i]["exact_line_precision"] == two[i]["exact_line_recall"] for i in one)


def test_nulls_and_legacy_rows(spark):
    df = spark.createDataFrame([("1", None, None), ("2", " a ", "a")], "id string, gt string, prediction string")
    r = {x["id"]: x for x in evaluate.evaluation_rows(df).collect()}
    assert r["1"]["wer"] == 0 and r["1"]["line_acc"] == 1 and r["2"]["len_gt"] == 3
    old = {x["id"]: x for x in evaluate.evaluation_rows(df, legacy=True).collect()}
    assert old["2"]["len_gt"] == 1 and "exact_line_f1" not in old["2"].asDict()


def test_macro_and_inclusion(spark):
    rows = spark.createDataFrame([("1", 1.0), ("2", 0.0)], "id string, wer double")
    got = evaluate.macro_average(rows, metrics=("wer",)).first()
    assert got["wer"] == 0.5 and got["id"] == "macro_avg" and got["len_gt"] is None
    assert evaluate.macro_average(rows.limit(0), metrics=("wer",)).count() == 0
    t = lambda name, ids: spark.createDataFrame([(i, name + i) for i in ids], f"id string, {name} string")
    images = spark.createDataFrame([("1", ["p"]), ("2", []), ("3", ["q"])], "id string, images array<string>")
    args = (t("gt", "1234"), t("transcription", "123"), t("ocr", "12"), images)
    ids = {m: sorted(r["id"] for r in evaluate.method_inputs(m, *args).collect()) for m in ("m1", "m2", "m3")}
    assert ids == {"m1": ["1", "3"], "m2": ["1", "3"], "m3": ["1", "2"]}
    assert {r["id"]: r["ocr"] for r in evaluate.method_inputs("m2", *args).collect()} == {"1": "ocr1", "3": ""}


def test_text_helpers(spark):
    df = spark.createDataFrame([("noise\nassistant\nold\nassistant\n assistant said ", "too many requests_Per_Day")], "a string, b string")
    r = df.select(X.assistant_reply(F.col("a")), X.quota_exhausted(F.col("b")), X.join_pages(F.array(F.lit("a "), F.lit(""), F.lit(None), F.lit("b"))), X.join_lines(F.array(F.lit("a"), F.lit(None), F.lit(""), F.lit("b")))).first()
    assert tuple(r) == ("said", True, "a \n\nb", "a\n\nb")


def test_distance_in_bands(spark):
    """Random pairs, near and far, equal to the plain edit distance; words too."""
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh é𝄞 "])
        a = [rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 40, 300])))]
        b = list(a)
        for _ in range(rng.choice([0, 1, 2, 5, 60])):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 2)
        rows.append(("".join(a), "".join(b) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))))
    rows += [("x" * 3000, "y" * 2900), ("", ""), ("", "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(M.distance(F.col("a"), F.col("b")) != F.levenshtein("a", "b")).count() == 0

    def words(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
            d = e
        return d[-1]

    r, h = F.split("a", " "), F.split("b", " ")
    got = df.select("a", "b", M.word_distance(r, h, M.vocabulary(r, h)).alias("d")).collect()
    assert all(x["d"] == words(x["a"].split(" "), x["b"].split(" ")) for x in got)


def test_long_pairs_are_spread(spark):
    rows = [(str(i), "long " * 400 + str(i), "other " * 400) for i in range(64)] + [(str(100 + i), "a", f"b{i}") for i in range(640)] + [("9", "copy " * 400, "x" * 2000)] * 64
    dealt = M.spread(spark.createDataFrame(rows, "id string, gt string, prediction string"), parts=8)
    long_ = [r["count"] for r in dealt.where("length(gt) > 100").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert dealt.rdd.getNumPartitions() == 8 and len(long_) == 8 and max(long_) <= 32
