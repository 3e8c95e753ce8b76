"""The prefix trie of conversations as preorder intervals.

1. Turns are numbered by counts within (conversation, range) and the counts of the ranges before, so that one conversation may hold
   any share of the rows. splice() puts the first turns of another conversation in front.
2. A node is the sequence of the first d turns: d and two 64-bit exclusive-or sums of hashes of (place, SHA-256 of role and text),
   which are running sums again. Nodes count their members in one aggregate.
3. Leaves are ranked lexicographically. A leaf's key has the chosen child of each node on its way that has more than one; the turns
   between do not order anything. (With N rows no key is longer than the root of 2 N: each choice is another conversation of that length.)
4. Preorder: a node stands at (rank of its first leaf, depth). Running sums of leaves and savings over that order are distributed; a
   subtree ends at its last leaf, so its leaves and savings are differences of two of these sums.

Defined results: turns go by number, null first, then by role and by the hash of role and text; null role or text is empty; rows without a
conv_id are one conversation, which borrows nothing, is never a smallest member and has no decimal form (-2^63 stands for it inside); repeated rows are
turns of their own; an empty table has no nodes, any other a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialize, small_batches
from quirefold.llm.ordered import in_parts, running_sums

NONE = -(2**63)
NODE = ["depth", "x1", "x2"]


@dataclass
class Trie:
    """nodes: depth, x1, x2 (together the node), conv_id, parent_conv_id, n_convs, n_ends, n_children, preorder, subtree_end, n_leaves, saved_tokens.
    ends: depth, x1, x2, c for each conversation (c; NONE: without conv_id) and the node at which it ends."""

    nodes: DataFrame
    ends: DataFrame


def numbered(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, pos from 1, part, said, n_chars) and conversations (c, n)."""
    small_batches(convs.sparkSession)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = convs.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("c"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("said"),
        F.length(text).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("tie"),  # spreads repeated rows over parts
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said"), F.col("tie")]
    rows = in_parts(rows, [F.col("c"), *order], "trie-turns", convs.count())
    segments = rows.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = segments.select("c", "part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    inside = Window.partitionBy("c", "part").orderBy(*order)
    rows = rows.withColumn("pos", F.row_number().over(inside)).join(before, ["c", "part"])
    turns = rows.select("c", (F.col("pos") + F.col("before")).alias("pos"), "part", "said", "n_chars")
    return materialize(turns, "trie-numbered"), materialize(segments.groupBy("c").agg(F.sum("n").alias("n")), "trie-convs")


def splice(turns: DataFrame, convs: DataFrame, base: Column, keep: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation begins with the first `keep` (at most `most`) turns of conversation `base`, followed by its own turns after its first `keep`.

    base and keep are expressions over c. Returns turns (c, d from 1, part, said, n_chars, last) and conversations (c, depth).
    """
    own = convs.select("c", "n", F.when(F.col("c") == NONE, 0).otherwise(keep).cast("long").alias("h"), F.when(F.col("c") != NONE, base).alias("b"))
    sizes = convs.select(F.col("c").alias("b"), F.col("n").alias("n_base"))
    own = own.join(sizes, "b", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("depth", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = materialize(own.select("c", "b", "n", "h", "lent", "depth"), "trie-plan")
    kept = turns.join(own.select("c", "h", "lent", "depth"), "c").where("pos > h").withColumn("d", F.col("pos") - F.col("h") + F.col("lent"))
    # Only conversations with a turn of the base in front; the first ranges have the number -1.
    first = turns.where(F.col("pos") <= most).select(F.col("c").alias("b"), F.col("pos").alias("d"), "said", "n_chars")
    lent = own.where("lent > 0").join(first, "b").where("d <= lent").withColumn("part", F.lit(-1))
    cols = ["c", "d", "part", "said", "n_chars", (F.col("d") == F.col("depth")).alias("last")]
    return kept.select(*cols).unionByName(lent.select(*cols)), own.select("c", "depth")


def _with_nodes(turns: DataFrame) -> DataFrame:
    """(c, depth, x1, x2, p1, p2, n_chars, last): the node at each turn and the one above it."""
    hashed = turns.select("c", "d", "part", "n_chars", "last", F.xxhash64("d", "said").alias("e1"), F.xxhash64("said", "d", F.lit(1)).alias("e2"))
    hashed = materialize(hashed, "trie-hashes")
    segments = hashed.groupBy("c", "part").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
    above = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = segments.select("c", "part", *[F.coalesce(F.bit_xor(f"s{i}").over(above), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    inside = Window.partitionBy("c", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hashed.select("*", *[F.bit_xor(f"e{i}").over(inside).alias(f"r{i}") for i in (1, 2)]).join(carried, ["c", "part"])
    x = {i: F.col(f"r{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)}
    out = rows.select("c", F.col("d").alias("depth"), *[x[i].alias(f"x{i}") for i in (1, 2)], *[x[i].bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)], "n_chars", "last")
    return materialize(out, "trie-rows")


def build(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of turns and conversations as splice() gives them."""
    rows = _with_nodes(turns)
    smallest = F.min(F.when(F.col("c") != NONE, F.col("c"))).alias("conv_id")
    inner = rows.groupBy(*NODE, "p1", "p2").agg(F.min("c").alias("c"), smallest, F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = convs.agg(F.min("c").alias("c"), smallest, F.count(F.lit(1)).alias("n_convs"), F.sum((F.col("depth") == 0).cast("long")).alias("n_ends")).where("n_convs > 0")
    top = top.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), "c", "conv_id", "n_convs", zero.alias("n_chars"), "n_ends")
    nodes = materialize(inner.unionByName(top), "trie-nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = materialize(nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "trie-counted")

    # Leaves, each by one conversation that ends there, ranked by the children chosen where there is a choice.
    leaves = materialize(nodes.where("n_children = 0").select("c"), "trie-leaves")
    ways = materialize(rows.select("c", *NODE, "p1", "p2").join(leaves, "c", "left_semi"), "trie-ways")
    forks = children.where("n_children > 1").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"))
    keys = ways.join(forks, ["depth", "p1", "p2"], "left_semi").groupBy("c").agg(F.array_sort(F.collect_list(F.struct(*NODE))).alias("key"))
    keys = leaves.join(keys, "c", "left")
    n = nodes.count()
    keys = in_parts(keys, [F.col("key"), F.col("c")], "trie-keys", n)
    ranks = running_sums(keys, [F.col("key"), F.col("c")], {"rank": F.lit(1)}).select("c", "rank")
    ranks = materialize(ranks, "trie-ranks")
    spans = ways.join(ranks, "c").groupBy(*NODE).agg(F.min("rank").alias("first"), F.max("rank").alias("final"))
    whole = ranks.agg(F.min("rank").alias("first"), F.max("rank").alias("final"))
    spans = spans.unionByName(whole.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "first", "final"))

    # Preorder and running sums; a subtree ends where its last leaf stands.
    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    nodes = nodes.join(spans, NODE).withColumn("saved", saved).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    order = [F.col("first"), F.col("depth")]
    nodes = running_sums(in_parts(nodes, order, "trie-preorder", n), order, {"preorder": F.lit(1), "sum_leaves": F.col("leaf"), "sum_saved": F.col("saved")})
    nodes = materialize(nodes, "trie-sums")
    stops = nodes.where("leaf = 1").select(F.col("first").alias("final"), F.col("preorder").alias("subtree_end"), F.col("sum_leaves").alias("end_leaves"), F.col("sum_saved").alias("end_saved"))
    above = nodes.select(*[F.col(k).alias(p) for k, p in zip(NODE, ("up", "p1", "p2"), strict=True)], F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(stops, "final").withColumn("up", F.col("depth") - 1).join(above, ["up", "p1", "p2"], "left")
    out = out.select(
        *NODE,
        "conv_id",
        "parent_conv_id",
        "n_convs",
        "n_ends",
        "n_children",
        "preorder",
        "subtree_end",
        (F.col("end_leaves") - F.col("sum_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"),
    )
    ends = rows.where("last").select(*NODE, "c").unionByName(convs.where("depth = 0").select("depth", zero.alias("x1"), zero.alias("x2"), "c"))
    return Trie(materialize(out, "trie"), materialize(ends, "trie-ends"))


def end_digests(trie: Trie) -> DataFrame:
    """(depth, x1, x2, ends_sha256): SHA-256 of the decimal conv_ids that end at a node, ascending, joined by commas.

    Ids are joined range by range; a node's ranges then stream through one hash, as SHA-256 has no other way.
    """
    order = [F.col(k) for k in [*NODE, "c"]]
    parts = in_parts(trie.ends, order, "trie-end-parts", trie.ends.count())
    lists = parts.groupBy(*NODE, "part").agg(F.array_sort(F.collect_list("c")).alias("ids"))
    decimal = F.transform("ids", lambda c: F.when(c == NONE, F.lit("")).otherwise(c.cast("string")))
    lists = lists.select(*NODE, "part", F.array_join(decimal, ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch[k].to_pylist() for k in NODE], batch["ids"].to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], r, strict=True)) for r in out], schema)
            out = []
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], (*node, state.hexdigest()), strict=True))], schema)

    schema = pa.schema([*[(k, pa.int64()) for k in NODE], ("ends_sha256", pa.string())])
    dealt = lists.repartition(*NODE).sortWithinPartitions(*NODE, "part")
    return dealt.mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")
