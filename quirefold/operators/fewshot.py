"""Few-shot examples: samples of other documents for each document."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators.ordered import at_ranks

EXAMPLE = "struct<sample_id:string,gt_text:string,transcription:string,ocr_text:string,image_paths:array<string>>"


def seeded_examples(ids: DataFrame, pool: list[str], n: int, seed: int) -> DataFrame:
    """(id, position, sample_id) as the seeded standard generator draws them, one draw per document without that document.

    pool is one dataset's sorted ids, some hundreds: a driver-side list. For large pools use hashed_examples().
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                others = [p for p in pool if p != i]
                chosen = others if len(others) <= n else random.Random(seed).sample(others, n)
                rows += [(i, k, c) for k, c in enumerate(chosen)]
            yield pd.DataFrame(rows, columns=["id", "position", "sample_id"])

    return ids.select("id").mapInPandas(draw, "id string, position int, sample_id string")


def hashed_examples(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """(id, position, sample_id) by a seeded order of all ids: the n ids of lowest digest other than the document's own.

    Only the n + 1 lowest ids can ever be chosen, so the pool is cut to those (a bounded table) before it meets the documents.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")).cast("binary"))
    pool = ids.select(F.col("id").alias("sample_id"), digest.alias("digest")).distinct().orderBy("digest").limit(n + 1)
    pairs = ids.select("id").distinct().join(F.broadcast(pool), F.col("id") != F.col("sample_id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("digest")) - 1
    return pairs.withColumn("position", place.cast("int")).where(F.col("position") < n).select("id", "position", "sample_id")


def ring_examples(ids: DataFrame, n: int, seed: int, per_bucket: int = 1000) -> DataFrame:
    """(id, position, sample_id): each document's own n examples, the ids that follow it on the ring of seeded digests.

    The ring is cut into buckets by the digest's first digits; a bucket's documents see their own bucket and the first n of the next. So every document is
    an example of n others, and no task sees more than a bucket. Where there are no n others, all others are taken.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")).cast("binary"))
    rows = ids.select("id").where("id is not null").distinct().select("id", digest.alias("digest"))
    first = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    total = rows.count()
    buckets = max(1, total // per_bucket)
    held = lambda k: rows.withColumn("bucket", F.floor(first * k / 2**32).cast("int"))
    while buckets > 1:  # digests are even, so this ends with its first look
        sizes = held(buckets).groupBy("bucket").count().agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("n")).first()
        if sizes["n"] == buckets and sizes["least"] >= n:
            break
        buckets //= 2
    rows = held(buckets)
    heads = rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "id"))).where(F.col("place") <= n)
    heads = heads.select("id", "digest", F.pmod(F.col("bucket") - 1, F.lit(buckets)).alias("bucket"), F.lit(1).alias("lap"))
    ring = rows.withColumn("lap", F.lit(0)).unionByName(heads)
    order = Window.partitionBy("bucket").orderBy("lap", "digest", "id")
    k = min(n, total - 1)
    if k <= 0:
        return rows.where("false").select("id", F.lit(0).alias("position"), F.col("id").alias("sample_id"))
    after = ring.withColumn("next", F.array(*[F.lead("id", i).over(order) for i in range(1, k + 1)])).where("lap = 0")
    return after.select("id", F.posexplode("next").alias("position", "sample_id"))


def seeded_ranks(ids: DataFrame, pool: DataFrame, n: int, seed: int) -> DataFrame:
    """seeded_examples() for a pool (id) of any size.

    The generator draws places, which depend on the pool's size alone; a document that stands before a place moves it on by one. So only the ids at
    the places drawn, and at those after them, are looked up, 3 n at most, and compared with each document's own.
    """
    pool = pool.select("id").where("id is not null").distinct()
    total = pool.count()
    draw = lambda size: list(range(size)) if size <= n else random.Random(seed).sample(range(size), n)
    inside, outside = draw(max(0, total - 1)), draw(total)
    found = at_ranks(pool, "id", [*inside, *[p + 1 for p in inside], *outside])
    text = "array<struct<here:string,after:string>>"
    pairs = F.array(*[F.struct(F.lit(found.get(p)).alias("here"), F.lit(found.get(p + 1)).alias("after")) for p in inside]).cast(text)
    others = F.array(*[F.lit(found[p]) for p in outside]).cast("array<string>")
    member = ids.select("id").join(pool.withColumn("member", F.lit(True)), "id", "left")
    own = F.transform(pairs, lambda x: F.when(x["here"] < F.col("id"), x["here"]).otherwise(x["after"]))
    return member.select("id", F.posexplode(F.when(F.col("member"), own).otherwise(others)).alias("position", "sample_id"))


def load_examples(drawn: DataFrame, corpus: DataFrame, method: str) -> DataFrame:
    """(id, examples): array of EXAMPLE in drawn order, with only the inputs a method needs; samples lacking one are left out."""
    ocr = F.col("ocr") if method in ("m2", "m3") else F.lit(None).cast("string")
    images = F.col("images") if method in ("m1", "m2") else F.array().cast("array<string>")
    needed = F.col("gt").isNotNull() & F.col("transcription").isNotNull()
    if method == "m3":
        needed = needed & F.col("ocr").isNotNull()
    if method in ("m1", "m2"):
        needed = needed & (F.size("images") > 0)
    source = corpus.where(needed).select(F.col("id").alias("sample_id"), F.struct(F.col("id").alias("sample_id"), F.col("gt").alias("gt_text"), "transcription", ocr.alias("ocr_text"), images.alias("image_paths")).cast(EXAMPLE).alias("example"))
    joined = drawn.join(source, "sample_id")
    return joined.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "example"))), lambda x: x["example"]).alias("examples"))


def prompt_images(examples: str, page: str):
    """First image of each example, then the page itself."""
    firsts = F.filter(F.transform(F.col(examples), lambda e: F.get(e["image_paths"], F.lit(0))), lambda p: p.isNotNull())
    return F.concat(F.coalesce(firsts, F.array().cast("array<string>")), F.array(page))
