"""Summaries of many evaluation files: one long table, one wide pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import naming
from quirefold.functions.metrics import METRICS

VALUES = ("len_gt", "len_pred", *METRICS)


def summary_long(rows: DataFrame) -> DataFrame:
    """Evaluation rows with their `file` (stem) to one row per file: dataset, method, file, n_samples, values of its first macro row.

    Values are tried as numbers, others become null. A file without a macro row fails the query. One pass: the macro row
    and the sample count come from the same aggregate.
    """
    present = [c for c in VALUES if c in rows.columns]
    is_macro = F.col("id") == "macro_avg"
    numbers = F.struct(*[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in present])
    order = F.col("_pos") if "_pos" in rows.columns else F.lit(0)
    per_file = rows.groupBy("file").agg(
        F.min_by(F.when(is_macro, numbers), F.when(is_macro, order)).alias("m"),
        F.count_if(is_macro).alias("n_macro"),
        F.count_if(~is_macro & (F.col("id") != "")).alias("n_samples"),
    )
    name = naming.result_file(F.col("file"))
    checked = F.when(F.col("n_macro") > 0, F.col("m")).otherwise(F.raise_error(F.concat(F.lit("no macro_avg row in "), F.col("file"))).cast(numbers_type(present)))
    per_file = per_file.select(name.alias("_n"), "file", "n_samples", checked.alias("m"))
    return per_file.select(F.col("_n.dataset").alias("dataset"), F.col("_n.method").alias("method"), "file", "n_samples", *[F.col(f"m.{c}").alias(c) for c in present])


def numbers_type(columns: list[str]) -> str:
    return "struct<" + ",".join(f"{c}:double" for c in columns) + ">"


def summary_wide(long: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """One row per dataset, columns {method}_{metric}: the first non-null value in order of file. All-null columns are left out.

    The pivot's columns are the methods, a handful; without `methods` they are read from the long table (one row per file).
    """
    methods = methods or sorted(r["method"] for r in long.select("method").distinct().collect())
    values = [c for c in VALUES if c in long.columns]
    cells = []
    for v in values:
        for m in methods:
            here = (F.col("method") == m) & F.col(v).isNotNull()
            cells.append(F.min_by(F.when(here, F.col(v)), F.when(here, F.col("file"))).alias(f"{m}_{v}"))
    wide = long.groupBy("dataset").agg(*cells)
    filled = wide.agg(*[F.count(c).alias(c) for c in wide.columns]).first().asDict()
    return wide.select("dataset", *[c for c in wide.columns if c != "dataset" and filled[c]]).orderBy("dataset")


def preview(wide: DataFrame, columns: int = 8, rows: int = 20) -> DataFrame:
    return wide.select(*wide.columns[:columns]).orderBy("dataset").limit(rows)
