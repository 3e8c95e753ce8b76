"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

1. Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share `budget` times all
   words. No target exceeds `cap` times its source; the excess is shared again by weight until none does
   (water filling, solved in closed form over sources sorted by cap per weight).
2. Each source is dealt into shards of about `shard_words` words by a seeded hash, so a source with a third of
   all rows is spread over many tasks. Equal blocks of `block_words` words are seats: first sources, then
   the shards of a source get seats by highest quotients v / (2 s + 1), giving integer quotas per shard. A shard takes
   the words of its quota, `cap` times its own at most; the words by which a source then misses its target (a part of a block,
   or the whole target of a source too small for a seat) are put right in the shards with most room.
3. Inside a shard documents are laid end to end in seeded order and cut into blocks. Of t words to take from n, every word
   is taken t // n times, and t % n words once more: whole blocks in the order of a seeded permutation, the last in part.

Defined results: null text has size 0 and takes 0; an all-empty table has targets of 0; a null source is a source
of its own, last in order; repeated rows are independent documents; ties in the seeded order are broken by doc_id,
then by size, where equal rows are interchangeable; an empty table gives no rows. Columns of the input that clash
with result names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialize, small_batches, word_count

#: Weights dealt to the sources in turn: fixed values.
WEIGHTS = (3.0, 1.0, 2.0)
#: Large primes, multipliers of the seeded block permutation: fixed values.
PRIMES = (2147483647, 1000000007, 998244353)


def source_targets(sizes: DataFrame, budget: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, weight, target), one row per source. sizes: (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("nth", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", "nth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    w = w.withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(down))
    level = F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "nth", "level_here"))).over(everything)["level_here"]
    w = w.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return w.select("source", "source_size", "weight", target.cast("double").alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """parties plus `quota`: the seats of each group dealt to its parties by highest quotients votes / (2 s + 1).

    Every party starts with its rounded share; only the few seats by which those differ from the total are
    then contested, so the work is in proportion to the number of parties, not of seats. Ties go to the smaller
    key. Parties without votes get no seat.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_all", F.sum(votes).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0))
    p = p.withColumn("_share", share).withColumn("_first", F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long"))
    p = p.withColumn("_gap", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_first").over(whole)).otherwise(F.lit(0)).cast("long"))
    # No party gains or loses more seats than this (a rounded share moves by at most one above its share of the gap).
    most = F.ceil(F.col("_share") * (F.abs("_gap") + F.col("_n"))).cast("long") + 1
    step = F.explode(F.when((F.col("_gap") != 0) & (F.col("_share") > 0), F.sequence(F.lit(1).cast("long"), F.least(most, F.abs("_gap")))).otherwise(F.array().cast("array<bigint>")))
    seat = F.when(F.col("_gap") > 0, F.col("_first") + F.col("_step") - 1).otherwise(F.col("_first") - F.col("_step"))
    c = p.select(*group, key, "_gap", "_first", votes, step.alias("_step")).withColumn("_seat", seat).where("_seat >= 0")
    c = c.withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
    best = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    signed = F.when(F.col("_gap") > 0, -F.col("_quotient")).otherwise(F.col("_quotient"))
    won = c.withColumn("_rank", F.row_number().over(best.orderBy(signed, key, "_step"))).where(F.col("_rank") <= F.abs("_gap"))
    moved = won.groupBy(*group, key).agg(F.sum(F.signum("_gap")).cast("long").alias("_moved"))
    joined = p.alias("p").join(moved.alias("m"), [F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}")) for k in [*group, key]], "left")
    keep = [F.col(f"p.{x}") for x in parties.columns]
    return joined.select(*keep, (F.col("p._first") + F.coalesce("m._moved", F.lit(0))).alias("quota"))


def mix(
    docs: DataFrame,
    budget: float = 1.5,
    cap: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    block_words: int = 128,
    shard_words: int = 500_000,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, first_word, shard_size, quota, copies, extra, offset, multiplier, block_words, taken).

    copies_of_word() turns the layout columns into the number of times the mix takes a word of the document.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    narrow = materialize(narrow, "mix-sizes")
    sources = materialize(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), budget, cap, weights), "mix-sources")
    seats = sources.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long"))
    sources = materialize(sainte_lague(seats, [], "source", "target", "_seats").drop("_seats"), "mix-quotas")
    s, n = sources.alias("s"), narrow.alias("n")
    shards = F.greatest(F.lit(1), F.ceil(F.col("s.source_size") / shard_words)).cast("long")
    dealt = n.join(s, F.col("n.source").eqNullSafe(F.col("s.source"))).select(
        "n.doc_id", "n.source", "n.size", "s.source_size", "s.target", F.col("s.quota").alias("source_quota"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("n.doc_id")), shards).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("n.doc_id")).alias("_draw"),
    )
    sums = dealt.groupBy("source", "shard", "source_quota", "target").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(sums, ["source", "source_quota"], "shard", "shard_size", "source_quota")
    quotas = quotas.withColumn("_most", F.floor(F.col("shard_size") * F.lit(float(cap)))).withColumn("_words", F.least(F.col("quota") * block_words, "_most"))
    own = Window.partitionBy("source", "source_quota")
    quotas = quotas.withColumn("_short", F.round("target").cast("long") - F.sum("_words").over(own))
    room = F.when(F.col("_short") > 0, F.col("_most") - F.col("_words")).otherwise(F.col("_words"))
    quotas = quotas.withColumn("_room", room)
    before = F.coalesce(F.sum("_room").over(own.orderBy(F.desc("_room"), "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.greatest(F.lit(0), F.least("_room", F.abs("_short") - before))
    words = F.col("_words") + F.when(F.col("_short") > 0, moved).otherwise(-moved)
    quotas = quotas.withColumn("copies", F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0)).cast("long"))
    quotas = quotas.withColumn("extra", (words - F.col("copies") * F.col("shard_size")).cast("long")).select("source", "shard", "shard_size", "quota", "copies", "extra")
    line = Window.partitionBy("source", "shard").orderBy("_draw", "doc_id", "size")
    laid = dealt.withColumn("first_word", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    d, q = laid.alias("d"), quotas.alias("q")
    # one row per document here; shards are bounded, so the join's key holds few rows
    both = d.join(q, F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
    draw = F.xxhash64(F.lit(seed + 2), F.coalesce(F.col("d.source"), F.lit("")), F.col("d.shard"))
    out = both.select("d.doc_id", "d.source", "d.size", "d.source_size", "d.target", "d.first_word", "q.shard_size", "q.quota", "q.copies", "q.extra", draw.alias("_draw"), F.lit(block_words).cast("long").alias("block_words"))
    blocks = _blocks()
    fit = [F.when(blocks % p != 0, F.lit(p)) for p in PRIMES]
    out = out.withColumn("offset", F.pmod(F.col("_draw"), blocks)).withColumn("multiplier", F.coalesce(*fit)).drop("_draw")
    size, at, end = F.col("block_words"), F.col("first_word"), F.col("first_word") + F.col("size")
    b0, b1 = F.floor(at / size).cast("long"), F.floor((end - 1) / size).cast("long")
    inside = lambda b: F.greatest(F.lit(0), F.least(end, b * size + taken_from(b)) - F.greatest(at, b * size)).cast("long")
    more = F.when(F.col("extra") > 0, F.aggregate(F.sequence(b0, b1), F.lit(0).cast("long"), lambda a, b: a + inside(b))).otherwise(F.lit(0))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("copies") * F.col("size") + more)
    return out.withColumn("taken", taken.cast("long"))


def _blocks() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block_words"))).cast("long")


def taken_from(block: Column) -> Column:
    """How many words at the start of a block are taken once more: all of those the seeded permutation puts first, part of the last."""
    blocks, size = _blocks(), F.col("block_words")
    place = lambda b: F.pmod(b * F.col("multiplier") + F.col("offset"), blocks)
    before = place(block) * size - F.when(place(block) > place(blocks - 1), blocks * size - F.col("shard_size")).otherwise(F.lit(0))
    return F.least(F.greatest(F.col("extra") - before, F.lit(0)), size)


def copies_of_word(word: Column) -> Column:
    """How often the mix takes the word of this 0-based index; needs the layout columns of mix()."""
    at = F.col("first_word") + word
    block = F.floor(at / F.col("block_words")).cast("long")
    return F.col("copies") + F.when(at - block * F.col("block_words") < taken_from(block), F.lit(1)).otherwise(F.lit(0))
