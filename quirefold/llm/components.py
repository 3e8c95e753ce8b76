"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the same over a component.

    Each round maps every node to the least of itself and its neighbours, in an order by a hash that differs from round to round, and
    contracts the edges by that map. So stars vanish in one round and about a third of a chain stays, whatever the names.
    Rounds are written out; the maps are composed at the end.
    """
    left = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    maps = []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("h"), F.col(c).alias("n"))
        to = materialize(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("parent")), "parents")
        maps.append(to)
        at_a, at_b = to.select(F.col("node").alias("a"), F.col("parent").alias("pa")), to.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = left.join(at_a, "a").join(at_b, "b").where("pa <> pb")
        left = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[0].select("node", F.col("parent").alias("label"))
    for to in maps[1:]:
        step = to.select(F.col("node").alias("label"), F.col("parent").alias("_next"))
        out = out.join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label"))
    return materialize(out, "components")
