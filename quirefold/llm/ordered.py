"""Numbers and running sums over a sorted table of any size: parts of a range order, sums inside each, and the sums of the parts before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialize, shuffle_width


def in_parts(df: DataFrame, order: list[Column], tag: str, rows: int, per_part: int = 500_000) -> DataFrame:
    """df, written in ranges of `order`, with the range's number as `part`: parts ascend with the order, and a key with many rows is cut between parts.

    rows: how many df has. The order should not have many equal keys, as these share a part.
    """
    n = max(shuffle_width(df.sparkSession), -(-rows // per_part))
    return materialize(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), tag)


def running_sums(parts: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over the whole order of a table of in_parts()."""
    whole = parts.groupBy("part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    before = whole.select(F.col("part"), *[F.coalesce(F.sum(f"_{k}").over(above), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.select("*", *[F.sum(c).over(inside).alias(k) for k, c in sums.items()]).join(F.broadcast(before), "part")
    return out.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in sums else F.col(c) for c in out.columns if c not in {f"_{k}" for k in sums}])
