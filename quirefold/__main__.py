"""Evaluation from the command line: python -m quirefold --method m3 --documents D --results R --checkpoint C --dataset N --model P/M.

Evaluates what has no result yet. Ends with 0, or with 75 where a daily quota stopped it: finished rows are committed then, and the same
command goes on where it ended.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from quirefold.operators import align
from quirefold.operators.plugins import Backend, ModelSettings, QuotaExhausted
from quirefold.sources import corpus
from quirefold.streaming import incremental


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quirefold", description="Evaluates line breaks by a model, resuming where it stopped.")
    for name in ("documents", "results", "checkpoint", "dataset", "model"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--method", choices=("m1", "m2", "m3"), required=True)
    p.add_argument("--images", help="folder of page images, read as bytes (m1, m2)")
    p.add_argument("--backend", help="a registered backend; by default the provider in the model's name")
    p.add_argument("--max-new-tokens", type=int, default=2048)
    p.add_argument("--requests-per-minute", type=float, help="over all tasks")
    p.add_argument("--tasks", type=int, default=1, help="tasks that share the rate")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, factory: Callable[[ModelSettings], Backend] | None = None) -> int:
    """The exit code."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("quirefold").getOrCreate()
    options = {"tasks": a.tasks} | ({"requests_per_minute": a.requests_per_minute} if a.requests_per_minute else {})
    settings = ModelSettings(a.model, max_new_tokens=a.max_new_tokens, options=options)
    contents = corpus.image_contents(spark, a.images) if a.images else None
    fields = spark.read.parquet(a.documents).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    key = {"method": a.method, "dataset": a.dataset, "model": a.model, "n_shots": 0}
    try:
        incremental.evaluate_new(spark, a.documents, schema, lambda df: align.align(a.method, df, settings, backend=a.backend, factory=factory, contents=contents), a.results, a.checkpoint, key)
    except QuotaExhausted as e:
        print(f"stopped by a quota, run again to go on: {e}", file=sys.stderr)
        return QuotaExhausted.EXIT_CODE
    return 0


if __name__ == "__main__":
    sys.exit(main())
