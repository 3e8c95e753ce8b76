"""Text comparison metrics as Catalyst expressions.

Definitions (ref: truth, hyp: prediction):
  wer, cer           edit distance over words / code points of the stripped texts, by the length of ref;
                     for an empty ref 0 if hyp is empty too, else 1
  *_norm             after joining words by one space; wer_norm equals wer
  line_acc           share of line positions that agree, the shorter side padded by empty lines
  rev_line_acc       the same from the last line
  exact_line_*       precision, recall and F1 of the multisets of lines; 0 where undefined
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X

#: Metric columns of an evaluation row, in output order: fixed values.
METRICS = (
    "wer", "cer", "wer_norm", "cer_norm", "line_acc", "line_acc_norm", "rev_line_acc", "rev_line_acc_norm",
    "exact_line_precision", "exact_line_recall", "exact_line_f1",
    "exact_line_precision_norm", "exact_line_recall_norm", "exact_line_f1_norm",
)
LEGACY_METRICS = METRICS[:8]


def error_rate(distance: Column, ref_size: Column, hyp_size: Column) -> Column:
    empty = F.when(hyp_size == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(ref_size == 0, empty).otherwise(distance / ref_size)


#: Widths of the bands tried before the whole table of edit distances.
BANDS = (16, 128, 1024)


def _named(values: dict[str, Column], then) -> Column:
    """then(struct of values): an array of one binds the values to a name, so that each is made once."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), then), 1)


def _powers(size: Column) -> Column:
    """Powers of two up to size, falling."""
    top = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    return F.transform(F.sequence(top, F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def _climb(size: Column, fits) -> Column:
    """The greatest n up to size with fits(m, step) true for every step of n from m on; fits has to hold for all smaller n, too."""
    return F.aggregate(_powers(size), F.lit(0), lambda n, step: F.when(n + step <= size, F.when(fits(n, step), n + step).otherwise(n)).otherwise(n))


def trimmed(a: Column, b: Column, then) -> Column:
    """then(a, b) of two texts without their common beginning and end."""
    start = lambda x: _climb(F.least(F.length(x["a"]), F.length(x["b"])), lambda n, step: F.substring(x["a"], n + 1, step) == F.substring(x["b"], n + 1, step))
    rest = lambda x, k: F.substring(x[k], x["n"] + 1, F.length(x[k]))
    end = lambda x: _climb(F.least(F.length(x["a"]), F.length(x["b"])), lambda n, step: F.substring(x["a"], F.length(x["a"]) - n - step + 1, step) == F.substring(x["b"], F.length(x["b"]) - n - step + 1, step))
    front = lambda x, k: F.substring(x[k], F.lit(1), F.length(x[k]) - x["n"])
    cut = lambda x: _named({"a": rest(x, "a"), "b": rest(x, "b")}, lambda y: _named({"a": y["a"], "b": y["b"], "n": end(y)}, lambda z: _named({"a": front(z, "a"), "b": front(z, "b")}, lambda w: then(w["a"], w["b"]))))
    return _named({"a": a, "b": b}, lambda x: _named({"a": x["a"], "b": x["b"], "n": start(x)}, cut))


def _banded(a: Column, b: Column) -> Column:
    """Edit distance by tables of a band along the diagonal, each eight times as wide, until the distance lies within."""
    widths = F.array(*[F.lit(k) for k in BANDS], F.greatest(F.length(a), F.length(b)))
    return F.aggregate(widths, F.lit(-1), lambda d, k: F.when(d >= 0, d).otherwise(F.call_function("levenshtein", a, b, k)))


def distance(a: Column, b: Column) -> Column:
    """Edit distance of texts: nothing for equal ones, else what is left between common ends, in bands."""
    return F.when(a == b, F.lit(0)).otherwise(trimmed(a, b, _banded))


def vocabulary(r: Column, h: Column) -> Column:
    """The distinct words of two lists, in order."""
    return F.array_sort(F.array_distinct(F.concat(r, h)))


def coded(words: Column, vocabulary: Column) -> Column:
    """Words as single code points by their place in an ordered vocabulary of both texts, so that levenshtein counts words."""
    place = lambda w: _climb(F.size(vocabulary), lambda n, step: F.get(vocabulary, n + step - 1) <= w)
    digits = F.transform(words, lambda w: F.lpad(F.hex(place(w) + 0xFFFF), 8, "0"))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-32")


def word_distance(r: Column, h: Column, vocabulary: Column) -> Column:
    """Edit distance over words; equal lists are not coded."""
    return F.when(r == h, F.lit(0)).otherwise(trimmed(coded(r, vocabulary), coded(h, vocabulary), _banded))


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df dealt evenly to `parts` partitions (the cluster's cores and the session's shuffle partitions at least).

    An edit distance costs the product of two lengths, which partitions cut by bytes know nothing of; dealt one by one in the order of their
    hashes, long pairs and copies of one pair come to all tasks alike.
    """
    spark = df.sparkSession
    return df.repartition(parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def cer(ref: Column, hyp: Column) -> Column:
    return _named({"r": X.strip(ref), "h": X.strip(hyp)}, lambda x: error_rate(distance(x["r"], x["h"]), F.length(x["r"]), F.length(x["h"])))


def wer(ref: Column, hyp: Column) -> Column:
    rate = lambda x: error_rate(word_distance(x["r"], x["h"], x["both"]), F.size(x["r"]), F.size(x["h"]))
    return _named({"r": X.tokens(ref), "h": X.tokens(hyp)}, lambda x: _named({"r": x["r"], "h": x["h"], "both": vocabulary(x["r"], x["h"])}, rate))


def line_accuracy(ref: Column, hyp: Column) -> Column:
    """ref and hyp: arrays of lines."""
    same = F.size(F.filter(F.zip_with(ref, hyp, lambda x, y: F.coalesce(x, F.lit("")) == F.coalesce(y, F.lit(""))), lambda b: b))
    both_empty = (F.size(ref) == 0) & (F.size(hyp) == 0)
    return F.when(both_empty, F.lit(1.0)).when(F.size(ref) == 0, F.lit(0.0)).otherwise(same / F.greatest(F.size(ref), F.size(hyp)))


def reverse_line_accuracy(ref: Column, hyp: Column) -> Column:
    return line_accuracy(F.reverse(ref), F.reverse(hyp))


def line_hits(ref: Column, hyp: Column) -> Column:
    """Size of the multiset intersection of two arrays of lines."""
    sided = lambda arr, side: F.transform(arr, lambda x: F.struct(x.alias("line"), F.lit(side).alias("side")))
    state = "struct<line:string,open:int,hits:int>"

    def step(a: Column, x: Column) -> Column:
        open_ = F.when(a["line"] == x["line"], a["open"]).otherwise(0)
        hit = (x["side"] == 1) & (open_ > 0)
        return F.struct(x["line"].alias("line"), (open_ + F.when(x["side"] == 0, 1).when(hit, -1).otherwise(0)).alias("open"), (a["hits"] + hit.cast("int")).alias("hits")).cast(state)

    # In order, the lines of ref stand before equal ones of hyp, each of which uses one up.
    begin = F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("open"), F.lit(0).alias("hits")).cast(state)
    return F.aggregate(F.array_sort(F.concat(sided(ref, 0), sided(hyp, 1))), begin, step, lambda a: a["hits"])


def prf(hits: Column, n_ref: Column, n_hyp: Column) -> tuple[Column, Column, Column]:
    p = F.when(n_hyp > 0, hits / n_hyp).otherwise(F.lit(0.0))
    r = F.when(n_ref > 0, hits / n_ref).otherwise(F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def exact_line_prf(ref: Column, hyp: Column) -> tuple[Column, Column, Column]:
    return prf(line_hits(ref, hyp), F.size(ref), F.size(hyp))


def exact_line_prf_text(ref: Column, hyp: Column, normalized: bool = False) -> tuple[Column, Column, Column]:
    r, h = X.lines(ref), X.lines(hyp)
    if normalized:
        r, h = F.transform(r, X.normalize), F.transform(h, X.normalize)
    return exact_line_prf(r, h)


def with_metrics(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """df with len_gt, len_pred and METRICS. Nulls count as empty texts.

    Token and line arrays are columns of their own before any metric uses them, so each is made once.
    """
    gt, pred = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(hyp), F.lit(""))
    df = df.withColumns({"len_gt": F.length(gt), "len_pred": F.length(pred), "_r": X.strip(gt), "_h": X.strip(pred)})
    df = df.withColumns({"_rw": X.tokens(F.col("_r")), "_hw": X.tokens(F.col("_h")), "_rl": X.lines(F.col("_r")), "_hl": X.lines(F.col("_h"))})
    df = df.withColumns({"_voc": vocabulary(F.col("_rw"), F.col("_hw")), "_rn": F.array_join("_rw", " "), "_hn": F.array_join("_hw", " ")})
    df = df.withColumns({"_rln": F.transform("_rl", X.normalize), "_hln": F.transform("_hl", X.normalize)})
    df = df.withColumns({"_hits": line_hits(F.col("_rl"), F.col("_hl")), "_hits_norm": line_hits(F.col("_rln"), F.col("_hln"))})
    word = word_distance(F.col("_rw"), F.col("_hw"), F.col("_voc"))
    df = df.withColumns(
        {
            "wer": error_rate(word, F.size("_rw"), F.size("_hw")),
            "cer": error_rate(distance(F.col("_r"), F.col("_h")), F.length("_r"), F.length("_h")),
            "cer_norm": error_rate(distance(F.col("_rn"), F.col("_hn")), F.length("_rn"), F.length("_hn")),
            "line_acc": line_accuracy(F.col("_rl"), F.col("_hl")),
            "line_acc_norm": line_accuracy(F.col("_rln"), F.col("_hln")),
            "rev_line_acc": reverse_line_accuracy(F.col("_rl"), F.col("_hl")),
            "rev_line_acc_norm": reverse_line_accuracy(F.col("_rln"), F.col("_hln")),
        }
    )
    df = df.withColumn("wer_norm", F.col("wer"))  # splitting normalised text gives the same words
    for suffix, hits, r, h in (("", "_hits", "_rl", "_hl"), ("_norm", "_hits_norm", "_rln", "_hln")):
        p, c, f1 = prf(F.col(hits), F.size(r), F.size(h))
        df = df.withColumns({f"exact_line_precision{suffix}": p, f"exact_line_recall{suffix}": c, f"exact_line_f1{suffix}": f1})
    return df.drop("_r", "_h", "_rw", "_hw", "_rl", "_hl", "_voc", "_rn", "_hn", "_rln", "_hln", "_hits", "_hits_norm")
