"""Sinks: keyed tables first, the file-per-document forms on request."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.metrics import METRICS
from quirefold.operators.evaluate import LEGACY_ROW, ROW, macro_average
from quirefold.sources.shared import written


def write_predictions(df: DataFrame, path: str) -> None:
    """(id, prediction) as a Parquet table."""
    df.select("id", "prediction").write.mode("overwrite").parquet(path)


def write_text_per_id(df: DataFrame, folder: str, text: str = "text", suffix: str = ".txt") -> int:
    """<folder>/<id><suffix> for each row, in UTF-8 and to the byte; returns the number of files.

    An export for small corpora, to a folder that all executors mount. Each file is written beside its place and moved there, so
    a task that runs again, or dies, leaves only whole files. The table forms are for large corpora and other stores.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for i, t in zip(batch["id"], batch["value"], strict=True):
                handle, path = tempfile.mkstemp(dir=folder, prefix=".")
                with os.fdopen(handle, "wb") as f:
                    f.write((t or "").encode())
                os.replace(path, os.path.join(folder, f"{i}{suffix}"))
            yield pd.DataFrame({"n": [len(batch)]})

    written = df.select(F.col("id"), F.col(text).alias("value")).mapInPandas(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def evaluation_csv(rows: DataFrame, legacy: bool = False) -> DataFrame:
    """Lines (pos, value) of an evaluation file: header, rows by id, a blank line and the macro row. No macro row for no rows."""
    columns = LEGACY_ROW if legacy else ROW
    metrics = columns[3:]
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws(",", *[cell(c) for c in columns])
    quoted = F.when(F.col("id").rlike('[",\n]'), F.concat(F.lit('"'), F.replace("id", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("id"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "", ",".join(columns))], "part int, id string, value string")
    body = rows.withColumn("id", quoted).select(F.lit(1).alias("part"), "id", line.alias("value"))
    macro = macro_average(rows, metrics=metrics)
    blank = macro.select(F.lit(2).alias("part"), F.lit("").alias("id"), F.lit("").alias("value"))
    last = macro.select(F.lit(3).alias("part"), "id", line.alias("value"))
    return head.unionByName(body).unionByName(blank).unionByName(last)


def write_evaluation_csv(rows: DataFrame, path: str, legacy: bool = False) -> None:
    """One file, in order. The legacy form writes nothing for no rows."""
    if legacy and not rows.limit(1).count():
        return
    lines = evaluation_csv(rows, legacy).repartitionByRange(1, "part", "id").sortWithinPartitions("part", "id")
    lines.select("value").write.mode("overwrite").text(path)


def write_results(rows: DataFrame, path: str, keys: tuple[str, ...] = ("method", "dataset", "model", "n_shots")) -> None:
    """Appends to the keyed result table that takes the place of checkpoint files."""
    rows.write.mode("append").partitionBy(*keys).parquet(path)


def checkpoint_state(rows: DataFrame) -> DataFrame:
    """Checkpoint form of results: processed ids, rows as strings and metric sums per run."""
    keys = ["method", "dataset", "model", "n_shots"]
    as_row = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ROW])
    sums = F.create_map(*[x for m in METRICS for x in (F.lit(m), F.sum(m))])
    ordered = F.sort_array(F.collect_list(F.struct("id", as_row.alias("row"))))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["id"]).alias("processed_ids"), F.transform(ordered, lambda x: x["row"]).alias("rows"), sums.alias("sums"))


def write_checkpoint_json(rows: DataFrame, path: str) -> None:
    checkpoint_state(rows).coalesce(1).write.mode("overwrite").json(path)


def ocr_metadata(docs: DataFrame, dataset: str, segmenter: str, recognizer: str, model: str | None, cache_root: str, root: str) -> DataFrame:
    """(id, meta): the JSON sidecar of each recognised document."""
    fields = F.struct(
        "id", F.lit(dataset).alias("dataset"), F.lit(segmenter).alias("segmenter"), F.lit(recognizer).alias("recognizer"), F.lit(model).alias("recognizer_model"),
        "num_pages", "num_lines", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00").alias("timestamp_utc"),
        F.lit(cache_root).alias("cache_root"), F.concat(F.lit(f"{root}/ocr/"), "id", F.lit(".txt")).alias("ocr_path"), F.concat(F.lit(f"{root}/transcription/"), "id", F.lit(".txt")).alias("transcription_path"),
    )
    return docs.select("id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("meta"))


def write_ocr(docs: DataFrame, root: str, dataset: str, segmenter: str, recognizer: str, model: str | None, cache_root: str) -> int:
    """<root>/ocr/<id>.txt and <id>.meta.json for recognised documents (id, ocr, num_pages, num_lines); returns the number of documents.

    Recognised documents are a written table first, so models run once, whatever executors are lost.
    """
    docs = written(docs, "recognised")
    n = write_text_per_id(docs, f"{root}/ocr", "ocr")
    meta = ocr_metadata(docs, dataset, segmenter, recognizer, model, cache_root, root)
    write_text_per_id(meta, f"{root}/ocr", "meta", suffix=".meta.json")
    return n


def write_manifest(df: DataFrame, folder: str) -> None:
    """Unquoted TSV per part."""
    df.select("part", F.concat_ws("\t", "image_path", "text").alias("value")).write.mode("overwrite").partitionBy("part").text(folder)


def stats_json(stats: DataFrame, text_number: str, splits: list[str]) -> DataFrame:
    """(value): the nested statistics document."""
    one = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    part = lambda p: F.struct(*[one(p, c).alias(c) for c in ("count", "avg_words", "avg_chars")])
    whole = F.struct(F.lit(text_number).alias("text_number"), F.array(*map(F.lit, splits)).alias("splits"), part("train").alias("train"), part("val").alias("val"), F.sum("writers").alias("writers_total"), one("train", "writers").alias("writers_train"), one("val", "writers").alias("writers_val"))
    return stats.agg(F.to_json(whole).alias("value"))


def write_summary(long: DataFrame, wide: DataFrame, folder: str) -> None:
    long.orderBy("dataset", "method", "file").coalesce(1).write.mode("overwrite").csv(f"{folder}/long", header=True)
    wide.coalesce(1).write.mode("overwrite").csv(f"{folder}/wide", header=True)


def crop_jobs(lines: DataFrame, page: str, padding: int = 0) -> DataFrame:
    """What to cut: (page, line_index, name, box) for numbered line boxes; an image library does the cutting."""
    from quirefold.functions import geometry as G
    from quirefold.functions.naming import crop_name, stem

    padded = G.pad(F.struct("x1", "y1", "x2", "y2"), padding)
    return lines.select(page, "line_index", crop_name(stem(F.col(page)), F.col("line_index")).alias("name"), padded.alias("box"))
