"""Resumable evaluation as a stream of new documents.

The stream's checkpoint remembers which input files were taken. Finished rows and the documents that failed are two tables of one versioned
root (sources.versions): a batch adds to the first and replaces the second in one step. An anti-join drops ids that have a result,
so a rerun after a stop (a spent quota) goes on where it ended; documents that failed come again with the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.evaluate import evaluation_rows
from quirefold.operators.plugins import QuotaExhausted, raise_if_spent
from quirefold.sources import versions
from quirefold.sources.corpus import remove

KEYS = ("method", "dataset", "model", "n_shots")


ROWS, FAILED = "rows", "failed"
#: Parts of the result table after which a run writes it as one.
MANY = 64


def results(spark: SparkSession, root: str) -> DataFrame:
    """All finished rows, with the keys of their runs."""
    return versions.read(spark, root, ROWS)


def _of_run(df: DataFrame, key: dict) -> DataFrame:
    for k, v in key.items():
        df = df.where(F.col(k) == v)
    return df


def done_ids(spark: SparkSession, root: str, key: dict) -> DataFrame:
    """Ids of a run's finished rows."""
    if not versions.parts(spark, root, ROWS):
        return spark.createDataFrame([], "id string")
    return _of_run(results(spark, root), key).select("id").distinct()


def evaluate_new(spark: SparkSession, documents: str, schema: str, predict: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, key: dict) -> int:
    """Evaluates documents (id, gt, ...) that have no result, in micro-batches, until the input is read; returns the batches run.

    predict maps documents to (id, prediction, error); its rows are written before they are used, so each model call is made once.
    Finished rows are committed even where a quota ends the run: QuotaExhausted is raised after the batch that met it. Predictions are
    deleted once their batch is committed.
    """
    ran, tried = [], f"{checkpoint}_predictions"
    kept = schema + "".join(f", {k} {'int' if isinstance(v, int) else 'string'}" for k, v in key.items())

    def keyed(df: DataFrame) -> DataFrame:
        for k, v in key.items():
            df = df.withColumn(k, F.lit(v))
        return df

    def evaluate(df: DataFrame, name: str) -> DataFrame:
        """Predicts, and commits rows and failures of these documents; returns the predictions."""
        new = df.join(done_ids(spark, root, key), "id", "left_anti").dropDuplicates(["id"])
        predict(new).write.mode("overwrite").parquet(f"{tried}/{name}")
        got = spark.read.parquet(f"{tried}/{name}")
        rows = keyed(evaluation_rows(new.join(got.where("error is null").select("id", "prediction"), "id")))
        failed = keyed(new.join(got.where("error is not null").select("id"), "id", "left_semi"))
        before = versions.read(spark, root, FAILED, kept)
        left = before.join(keyed(df.select("id").distinct()), ["id", *key], "left_anti").select(failed.columns)
        versions.commit(spark, root, add={ROWS: rows}, replace={FAILED: left.unionByName(failed)})
        return got

    def again() -> None:
        failed = _of_run(versions.read(spark, root, FAILED, kept), key)
        name = f"again-{uuid.uuid4().hex}"
        raise_if_spent(evaluate(failed.drop(*key), name))
        remove(spark, f"{tried}/{name}")

    def batch(df: DataFrame, number: int) -> None:
        got = evaluate(df, f"batch-{number}")
        ran.append(number)
        stopped.extend(r["error"] for r in got.where(F.col("error").contains(QuotaExhausted.SIGN)).select("error").head(1))
        remove(spark, f"{tried}/batch-{number}")

    stopped: list[str] = []
    if versions.parts(spark, root, FAILED):
        again()
    query = spark.readStream.schema(schema).parquet(documents).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if len(versions.parts(spark, root, ROWS)) > MANY:
        versions.compact(spark, root, ROWS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if stopped:
        raise QuotaExhausted(stopped[0])
    return len(ran)
