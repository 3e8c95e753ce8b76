"""Evaluation: which documents a method takes, rows of metrics, macro and micro averages, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.functions.metrics import LEGACY_METRICS, METRICS, line_hits, prf, spread, with_metrics
from quirefold.operators.ordered import least_before

ROW = ("id", "len_gt", "len_pred", *METRICS)
LEGACY_ROW = ("id", "len_gt", "len_pred", *LEGACY_METRICS)


def method_inputs(method: str, gt: DataFrame, transcription: DataFrame, ocr: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Documents a method evaluates: id, gt, transcription, ocr, images.

    m1 and m2 need a page image, m3 does not look at images; m2 takes a missing OCR text as empty, m3 leaves the document out.
    Inputs: (id, gt), (id, transcription), (id, ocr), (id, images: array of paths).
    """
    df = gt.join(transcription, "id")
    if method in ("m1", "m2"):
        df = df.join(images.where(F.size("images") > 0), "id")
    else:
        df = df.withColumn("images", F.array().cast("array<string>"))
    if method == "m1" or ocr is None:
        return df.withColumn("ocr", F.lit(None).cast("string"))
    if method == "m2":
        return df.join(ocr, "id", "left").withColumn("ocr", F.coalesce("ocr", F.lit("")))
    return df.join(ocr, "id")


def not_processed(df: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows whose key has no result yet."""
    keys = keys or ["id"]
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def evaluation_rows(df: DataFrame, ref: str = "gt", hyp: str = "prediction", legacy: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row of metrics per document, pairs spread over tasks by number, not by bytes."""
    if legacy:  # this variant measures stripped texts
        df = df.withColumns({ref: X.strip(F.coalesce(F.col(ref), F.lit(""))), hyp: X.strip(F.coalesce(F.col(hyp), F.lit("")))})
    return with_metrics(spread(df), ref, hyp).select(*extra, *(LEGACY_ROW if legacy else ROW))


def macro_average(rows: DataFrame, by: tuple[str, ...] = (), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Unweighted means over documents, one row (per group); no row for no documents."""
    means = [F.avg(m).alias(m) for m in metrics]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), *means)
    return out.where("n_docs > 0").select(*by, F.lit("macro_avg").alias("id"), F.lit(None).cast("int").alias("len_gt"), F.lit(None).cast("int").alias("len_pred"), *metrics, "n_docs")


def with_macro_row(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows and, after them, their macro average."""
    return rows.unionByName(macro_average(rows, metrics=metrics).drop("n_docs"))


def micro_prf(df: DataFrame, ref: str, hyp: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact-line precision, recall and F1 over all lines of all documents."""
    d = df.select(*by, X.lines(F.coalesce(F.col(ref), F.lit(""))).alias("r"), X.lines(F.coalesce(F.col(hyp), F.lit(""))).alias("h"))
    d = d.select(*by, line_hits(F.col("r"), F.col("h")).alias("hits"), F.size("r").alias("nr"), F.size("h").alias("nh"))
    s = d.groupBy(*by).agg(F.sum("hits").alias("hits"), F.sum("nr").alias("lines_ref"), F.sum("nh").alias("lines_hyp"))
    p, r, f1 = prf(F.col("hits"), F.col("lines_ref"), F.col("lines_hyp"))
    return s.select(*by, "hits", "lines_ref", "lines_hyp", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def multiset_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset intersection of two line tables of one schema."""
    return a.intersectAll(b)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of batch means by batch size; 0 for no batch."""
    return F.coalesce(F.sum(value * weight) / F.sum(weight), F.lit(0.0))


def best_so_far(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Is a value strictly below all before it?"""
    found = least_before(rows, order, value, "_before")
    return found.withColumn("is_best", F.coalesce(F.col(value) < F.col("_before"), F.lit(True))).drop("_before")
