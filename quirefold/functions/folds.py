"""Left folds that give a list. Spark copies a fold's whole state at each step, so the list is built in chunks of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def chunks(items: Column, size: int = CHUNK) -> tuple[Column, Callable[[Column], Column]]:
    """The numbers of an array's parts of `size` items, none for an empty one, and the part of a number."""
    parts = F.ceil(F.size(items) / size).cast("int")
    numbers = F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), parts - 1))
    return numbers, lambda k: F.slice(items, k * size + 1, F.lit(size))


def fold(items: Column, carry: Column, carry_type: str, item_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """{carry, items}: step(carry, x) gives the next carry and an item of the list, or null for none.

    The inner fold copies a chunk's items at most, the outer one all items once for each chunk.
    """
    inside, whole = f"struct<carry:{carry_type},run:array<{item_type}>>", f"struct<carry:{carry_type},done:array<array<{item_type}>>>"
    numbers, part = chunks(items)

    def one(a: Column, x: Column) -> Column:
        after, item = step(a["carry"], x)
        return F.struct(after.alias("carry"), F.when(item.isNull(), a["run"]).otherwise(F.concat(a["run"], F.array(item))).alias("run")).cast(inside)

    def many(a: Column, k: Column) -> Column:
        run = F.aggregate(part(k), F.struct(a["carry"].alias("carry"), F.array().alias("run")).cast(inside), one)
        # an array of one binds the inner fold to a name
        return F.element_at(F.transform(F.array(run), lambda r: F.struct(r["carry"].alias("carry"), F.concat(a["done"], F.array(r["run"])).alias("done")).cast(whole)), 1)

    begin = F.struct(carry.alias("carry"), F.array().alias("done")).cast(whole)
    return F.aggregate(numbers, begin, many, lambda a: F.struct(a["carry"].alias("carry"), F.flatten(a["done"]).alias("items")))
