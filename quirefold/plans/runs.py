"""The table of evaluation runs: methods x data sets x shots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.naming import checkpoint_name
from quirefold.sources.corpus import registry

METHODS, SHOTS = ("m1", "m2", "m3"), (0, 1, 2)


def run_matrix(spark: SparkSession, model: str, methods: tuple[str, ...] = METHODS, shots: tuple[int, ...] = SHOTS) -> DataFrame:
    """(method, dataset, n_shots, model, output, checkpoint): a few dozen rows of constants."""
    m = F.explode(F.array(*map(F.lit, methods))).alias("method")
    df = registry(spark).select(F.col("name").alias("dataset"), m).select("*", F.explode(F.array(*map(F.lit, shots))).alias("n_shots"))
    safe = F.translate(F.lit(model), "/:", "__")
    df = df.withColumn("model", F.lit(model)).withColumn("output", F.concat("dataset", F.lit("_eval_"), "method", F.lit("_"), F.col("n_shots").cast("string"), F.lit("shot_"), safe, F.lit(".csv")))
    return df.withColumn("checkpoint", checkpoint_name(F.col("method"), F.col("dataset"), F.col("model"), F.col("n_shots"))).select("method", "dataset", "n_shots", "model", "output", "checkpoint")
