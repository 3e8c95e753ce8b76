"""Order statistics and running minima over a whole table: ranges of its order in parts, each with what the parts before it hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.sources.shared import written


def in_parts(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df written in as many ranges of `order` as the session shuffles to, with the range's number as `_part`; parts ascend with the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), tag)


def least_before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with the least value of all rows before each (null for none). Rows of one place in the order are one after another as they come."""
    rows = in_parts(df, [F.col(order)], "least-before")
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    whole = rows.groupBy("_part").agg(F.min(value).alias("_m")).select("_part", F.min("_m").over(above).alias("_above"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.min(value).over(inside)).join(F.broadcast(whole), "_part")
    return rows.withColumn(out, F.least("_inside", "_above")).drop("_part", "_inside", "_above")


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> dict[int, object]:
    """The values at some places (from 0) of the ascending order of a column; no more rows than those reach the driver."""
    rows = in_parts(df.select(column), [F.col(column)], "ranks")
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part
    wanted, at = [], 0
    for part in sorted(sizes):
        wanted += [(part, rank - at + 1, rank) for rank in sorted(set(ranks)) if at <= rank < at + sizes[part]]
        at += sizes[part]
    if not wanted:
        return {}
    asked = df.sparkSession.createDataFrame(wanted, "_part int, _place int, rank long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    found = rows.where(F.col("_part").isin(sorted({w[0] for w in wanted}))).withColumn("_place", place)
    return {r["rank"]: r[column] for r in found.join(F.broadcast(asked), ["_part", "_place"]).select("rank", column).collect()}
