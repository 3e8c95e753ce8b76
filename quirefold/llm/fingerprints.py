"""Bottom-k sketches of word-shingle hashes (DataFrame functions only).

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's 5-word shingles. Sketches of parts
merge into the sketch of the whole; two sketches estimate resemblance and containment, one the number of
distinct shingles. Below k shingles every figure is exact.

Defined results: null text is empty; a text of 1 to 4 words is one shingle; a text without words has an empty sketch,
which resembles only other empty ones (1.0) and contains nothing; equal texts have equal sketches; an empty table
gives no rows. In with_neighbour() rows are in the order (doc_id, text) with null ids first, so repeated ids and rows
each have a next row; one row alone is its own next. Columns of the input that clash with result names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialize, shuffle_width, small_batches, split_words

WIDTH, K = 5, 128
_LOW = -(2**63)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """df with column `out`: the sketch of column `text`. Stepwise columns, so that no step is computed twice."""
    w, h, low = f"_{out}_words", f"_{out}_hashes", f"_{out}_low"
    df = df.withColumn(w, F.transform(split_words(F.col(text)), lambda x: F.xxhash64(x)))
    n = F.size(w)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(*[F.get(F.col(w), i - 1 + j) for j in range(width)]))
    df = df.withColumn(h, F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(F.col(w)))).otherwise(every))
    # Of many hashes only the low ones can be among the k smallest; where repeats leave too few, all are taken.
    bound = F.lit(float(_LOW)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * k + 40) / F.greatest(F.size(h), F.lit(1)))
    df = df.withColumn(low, F.when(F.size(h) > 3 * k, F.array_distinct(F.filter(h, lambda x: x.cast("double") < bound))).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(out, F.slice(F.sort_array(F.when(F.size(low) >= k, F.col(low)).otherwise(F.array_distinct(h))), 1, k)).drop(w, h, low)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") - F.lit(float(_LOW))) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets; exact where both are below k."""
    whole = (F.size(a) < k) & (F.size(b) < k)
    union = F.sort_array(F.array_union(a, b))
    seen = F.when(whole, union).otherwise(F.slice(union, 1, k))
    both = F.size(F.array_intersect(F.array_intersect(a, b), seen))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(a == b, F.lit(1.0)).otherwise(both / F.size(seen))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 0 for an empty a."""
    r = resemblance(a, b, k)
    both = r * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + r)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _place(edges: Column, value: Column, most: int) -> Column:
    """How many of the ascending `edges`, `most` at most, are not above the value: a binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= value, at + step).otherwise(at))


def _ascending(edges: list[int]) -> list[int]:
    """Distinct edges; a value that takes more than one range of its own also ends one."""
    return sorted(set(edges) | {e + 1 for a, e in zip(edges, edges[1:], strict=False) if a == e})


def _quantiles(column: str, n: int) -> Column:
    return F.percentile_approx(column, [i / n for i in range(1, n)] or [0.5], 10 * n)


def _ranged(rows: DataFrame, coarse: list[int], fine: DataFrame, n: int) -> DataFrame:
    """rows with _coarse and _fine, the numbers of their range; the order of ranges is that of (_key, _start)."""
    edges = F.array(*map(F.lit, coarse)).cast("array<bigint>")
    rows = rows.withColumn("_coarse", _place(edges, F.col("_key"), len(coarse))).join(F.broadcast(fine), "_coarse")
    value = F.when(F.col("_one_key"), F.col("_start")).otherwise(F.col("_key"))
    return rows.withColumn("_fine", _place(F.col("_edges"), value, n)).drop("_edges", "_one_key")


def with_neighbour(docs: DataFrame, buckets: int | None = None, k: int = K) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each row and the next by doc_id, the last one's next being the first.

    Rows are dealt into about `buckets` ranges of doc_id, one exchange of the texts: coarse ranges first, and each of those into as many
    fine ones, so no list of edges is longer than the root of their number. A doc_id that fills a coarse range (null ids may) is cut
    by its texts' first bytes. The first row of each range is also put behind the last row of the range before, so no task sees
    more than its ranges. Unless told, a range holds about 32 MB of text at any size of the table. What is broadcast is one row of
    numbers for each range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("_key"))
    # The first seven bytes as a number: in the order of the texts.
    rows = rows.withColumn("_start", F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"))
    narrow = materialize(rows.select("_key", "_start", F.octet_length("text").alias("_bytes")), "neighbour-keys")
    size = narrow.agg(F.sum("_bytes").alias("b")).first()["b"] or 0
    buckets = buckets or shuffle_width(spark, -(-size // (32 << 20)))
    n_coarse = math.isqrt(max(0, buckets - 1)) + 1
    n_fine = -(-buckets // n_coarse)
    coarse = _ascending(narrow.agg(_quantiles("_key", n_coarse).alias("e")).first()["e"] or [])
    edges = F.array(*map(F.lit, coarse)).cast("array<bigint>")
    fine = narrow.withColumn("_coarse", _place(edges, F.col("_key"), len(coarse))).groupBy("_coarse")
    fine = fine.agg((F.min("_key") == F.max("_key")).alias("_one_key"), _quantiles("_key", n_fine).alias("_keys"), _quantiles("_start", n_fine).alias("_starts"))
    fine = materialize(fine.select("_coarse", "_one_key", F.array_distinct(F.when(F.col("_one_key"), F.col("_starts")).otherwise(F.col("_keys"))).alias("_edges")), "neighbour-edges")
    rows = _ranged(rows, coarse, fine, n_fine)
    at = ["_coarse", "_fine"]
    heads = _ranged(narrow.drop("_bytes"), coarse, fine, n_fine).groupBy(*at).agg(F.min(F.struct("_key", "_start")).alias("_head"))
    ring = Window.orderBy(*at)  # one row of numbers for each range
    ends = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct(*at)
    heads = heads.select(*at, "_head._key", "_head._start", F.coalesce(F.lag(here).over(ring), F.last(here).over(ends)).alias("_before"))
    heads = materialize(heads, "neighbour-heads")
    firsts = rows.join(F.broadcast(heads), [*at, "_key", "_start"]).groupBy("_before", "_key").agg(F.min("text").alias("text"))
    guests = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", "_key", "_before._coarse", "_before._fine", F.lit(1).alias("_guest"))
    line = Window.partitionBy(*at).orderBy("_guest", "_key", "text")
    both = rows.drop("_start").withColumn("_guest", F.lit(0)).unionByName(guests).repartition(shuffle_width(spark, -(-size // (128 << 20))), *at)
    both = both.withColumn("next_text", F.lead("text").over(line))
    both = with_sketch(both, "text", "sketch", k)
    both = both.withColumn("next_sketch", F.lead("sketch").over(line))
    return both.where("_guest = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")
