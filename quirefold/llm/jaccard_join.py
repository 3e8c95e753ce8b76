"""Grouped prefix join: which documents share enough of their word shingles, and their components.

1. Every document becomes its set of distinct shingles of `width` words (64-bit hashes). Document frequencies come back
   from the exchange of grams.py; a set's prefix is its n - ceil(t n) + 1 rarest shingles. Two sets of
   Jaccard similarity t or more share a prefix shingle, so one whose prefix has no shingle of another document is done.
2. Documents with equal sets are one class; classes with identical prefixes and size are one group.
3. Groups that share a prefix shingle, in one step of sizes (of 1 / t) or in neighbouring ones, are tied: edges to the least of them, in
   proportion to the prefixes. What is not tied is filtered out. Tied sets of up to `chunk` classes are compared as a whole, each set sent once.
4. In larger tied sets the ties are not taken as they come. A prefix shingle of at most `few` classes gives group pairs, filtered
   by size and by position (after their first common shingle there have to be enough left on both sides), each pair once; pairs are
   expanded to their classes and verified. Shingles of more classes tie their groups anew, by themselves: these sets are
   dealt by step and hash into parts of about `chunk`, and parts of one step or of neighbouring ones are compared, so that no
   pairs are emitted for hot shingles.
5. All comparisons are exact. Components of the verified links, and the smallest doc_id of each.

Defined results: with fewer words than `width` the whole text is one shingle; a null text or one without words has an empty
set, links with nothing and is its own component; equal non-empty sets always link; repeated rows are rows of one class;
null doc_ids are kept and never the smallest; an empty table gives no rows; other columns are ignored; very long texts
are sets like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import grams
from quirefold.llm.common import materialize, release_memory, small_batches
from quirefold.llm.components import components

RECORD = "doc_id {}, n_shingles long, class string, grp string, prefix array<long>, places array<int>, shingles binary"


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    h, edges = grams.hashed_words(texts)
    whole = h.copy()
    for k in range(1, width):
        whole[: len(h) - k] = grams.mix(whole[: len(h) - k], h[k:])
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        n = b - a
        if 0 < n < width:
            short = h[a : a + 1]
            for k in range(1, n):
                short = grams.mix(short, h[a + k : a + k + 1])
            out.append(short)
            continue
        s = np.sort(whole[a : max(a, b - width + 1)])
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if n else s)
    return out


def _required(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _split(values: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes by shard: (order, shard, cuts)."""
    shard = grams.shard_of(values, shards)
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    s = shard[order]
    return order, s, np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else np.zeros(1, np.int64)


def records(docs: DataFrame, percent: int, width: int, block_bytes: int, shard_tokens: int) -> DataFrame:
    """RECORD rows: prefix holds the prefix shingles that another document has, places where they stand in the set, the rarest first; shingles is null
    where there are none."""
    small_batches(docs.sparkSession)
    rows, shards = grams.in_blocks(docs, block_bytes, shard_tokens)
    grouped = rows.groupBy("block")
    named = rows.schema["doc_id"].dataType.simpleString()  # bigint or string
    id_type = pa.string() if named == "string" else pa.int64()

    def send(key: tuple, table: pa.Table) -> pa.Table:
        release_memory()  # what the group before has freed
        sets = shingle_sets(table.column("text"), width)
        every = np.concatenate(sets)
        values, counts = _runs(np.sort(every))
        order, s, cuts = _split(values, shards)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = order[a:b]
            out.append((int(s[a]), key[0].as_py(), grams.pack(values[part] >> np.uint64(24), 5), grams.squeeze(counts[part].astype(np.uint32))))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["shard", "block", "keys", "counts"])

    sent = grouped.applyInArrow(send, "shard long, block int, keys binary, counts binary")

    def answer(table: pa.Table) -> pa.Table:
        release_memory()
        lists = [grams.unpack(d, 5) for d in table.column("keys").to_pylist()]
        counts = np.concatenate([grams.expand(d, "<u4") for d in table.column("counts").to_pylist()]).astype(np.int64)
        every = np.concatenate(lists)
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        keys, total = every[first], np.add.reduceat(counts[order], first)
        codes = [grams.squeeze(grams.count_code(total[np.searchsorted(keys, k)])) for k in lists]
        return pa.table([table.column("shard"), table.column("block"), pa.array(codes, pa.binary())], names=["shard", "block", "codes"])

    answers = sent.groupBy("shard").applyInArrow(answer, "shard long, block int, codes binary")

    def combine(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        release_memory()
        sets = shingle_sets(table.column("text"), width)
        values, _ = _runs(np.sort(np.concatenate(sets)))
        order, s, cuts = _split(values, shards)
        replies = dict(zip(got.column("shard").to_pylist(), got.column("codes").to_pylist(), strict=True))
        codes = np.zeros(len(values), np.uint8)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            codes[order[a:b]] = grams.expand(replies[int(s[a])], "u1")
        out = []
        for doc_id, h in zip(table.column("doc_id").to_pylist(), sets, strict=True):
            n = len(h)
            if not n:
                out.append((doc_id, 0, None, None, [], [], None))
                continue
            code = codes[np.searchsorted(values, h)]
            keep = np.lexsort((h, code))[: n - _required(n, percent) + 1]
            prefix = h[keep]
            places = np.flatnonzero(code[keep] > 1)
            shared = prefix[places].view(np.int64)
            data = h.tobytes()
            group = hashlib.md5(np.sort(prefix).tobytes() + n.to_bytes(8, "little")).hexdigest()
            out.append((doc_id, n, hashlib.md5(data).hexdigest(), group, shared.tolist(), places.tolist(), data if len(shared) else None))
        kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n_shingles", "class", "grp", "prefix", "places", "shingles"])

    return materialize(grouped.cogroup(answers.groupBy("block")).applyInArrow(combine, RECORD.format(named)), "join-records")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


def verified_links(names: list[str], sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[str, str]]:
    """Links that make the components of all linked pairs of sets; with `sides`, of pairs across the two sides."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    every = np.concatenate([sets[i] for i in order])
    universe, flat = np.unique(every, return_inverse=True)
    begin = np.cumsum(size) - size
    side = np.zeros(len(order), np.int8) if sides is None else sides[order]
    root = np.arange(len(order))
    seen = np.zeros(len(universe), bool)
    links = []
    for i in range(len(order)):
        # sets of i's size or above, up to the largest that can still link
        last = int(np.searchsorted(size, 100 * size[i] // percent, side="right"))
        if last <= i + 1:
            continue
        open_ = root[i + 1 : last] != root[i]
        if sides is not None:
            open_ &= side[i + 1 : last] != side[i]
        if not open_.any():
            continue
        seen[flat[begin[i] : begin[i] + size[i]]] = True
        a, b = begin[i + 1], begin[last - 1] + size[last - 1]
        shared = np.add.reduceat(seen[flat[a:b]].astype(np.int64), begin[i + 1 : last] - a)
        seen[flat[begin[i] : begin[i] + size[i]]] = False
        for j in (np.flatnonzero(open_ & (100 * shared >= percent * (size[i] + size[i + 1 : last] - shared))) + i + 1).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                links.append((names[order[i]], names[order[j]]))
    return links


def _tied(held: DataFrame) -> DataFrame:
    """(node, label) of groups (gram, step, grp) that share a gram in one step or in neighbouring ones: edges to the least of a step, and from it to the next."""
    firsts = materialize(held.groupBy("gram", "step").agg(F.min("grp").alias("least"), F.count(F.lit(1)).alias("m")), "join-firsts")
    own = held.join(firsts.where("m > 1").select("gram", "step", "least"), ["gram", "step"]).where("grp <> least").select(F.col("grp").alias("a"), F.col("least").alias("b"))
    above = firsts.select("gram", (F.col("step") - 1).alias("step"), F.col("least").alias("next"))
    return components(own.unionByName(firsts.join(above, ["gram", "step"]).select(F.col("least").alias("a"), F.col("next").alias("b"))))


def group_pairs(held: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """(a, b) of groups (gram, place, grp, n, k classes) that share a gram, once each: a <= b, a = b where a group has several classes.

    Filtered by size and position. Pairs of groups with one label in hot (node, label) are left out: they are compared there.
    """
    labels = hot.select(F.col("node").alias("grp"), F.col("label"))
    held = held.join(labels, "grp", "left")
    x, y = held.alias("x"), held.alias("y")
    least = F.expr(f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}")
    pairs = x.join(y, F.col("x.gram") == F.col("y.gram")).where((F.col("x.grp") < F.col("y.grp")) | ((F.col("x.grp") == F.col("y.grp")) & (F.col("x.k") > 1)))
    pairs = pairs.where(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")).where(F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= least)
    pairs = pairs.where(~F.coalesce(F.col("x.label") == F.col("y.label"), F.lit(False)))
    return pairs.select(F.col("x.grp").alias("a"), F.col("y.grp").alias("b")).distinct()


def _pair_links(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the classes of group pairs, by their sets."""
    side = lambda k: classes.select(F.col("grp").alias(k), F.col("class").alias(f"class_{k}"))
    each = pairs.join(side("a"), "a").join(side("b"), "b").where("a <> b or class_a < class_b").select("class_a", "class_b")
    sets = lambda k: classes.select(F.col("class").alias(f"class_{k}"), F.col("shingles").alias(f"set_{k}"))
    each = each.join(sets("a"), "class_a").join(sets("b"), "class_b").select("class_a", "class_b", "set_a", "set_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            found = batch.select(["class_a", "class_b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, names=["a", "b"])

    return each.mapInArrow(verify, "a string, b string")


def join_components(docs: DataFrame, percent: int = 90, width: int = 3, chunk: int = 1000, few: int = 32, block_bytes: int = 4_000_000, shard_tokens: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    rows = records(docs, percent, width, block_bytes, shard_tokens)
    shared = rows.where("shingles is not null")
    n = F.col("n_shingles")
    step = (F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) + 1e-9) if percent < 100 else n).cast("int")
    groups = shared.select("grp", "prefix", "places", step.alias("step"), n.alias("n")).dropDuplicates(["grp"])
    tied = _tied(groups.select(F.explode("prefix").alias("gram"), "step", "grp"))
    # Groups of more than one class, or tied to others, are expanded; an exchange of their sets only.
    classes = shared.select("class", "grp", step.alias("step"), "shingles").dropDuplicates(["class"])
    g = tied.select(F.col("node").alias("grp"), "label")
    classes = classes.join(g, "grp", "left").withColumn("label", F.coalesce("label", "grp"))
    classes = materialize(classes.select("class", "grp", "label", "step", "shingles"), "join-classes")
    large = materialize(classes.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > chunk).select("label"), "join-large")
    links = []
    if large.limit(1).count():
        inside = materialize(classes.join(large, "label", "left_semi").select("class", "grp", "shingles"), "join-inside")
        held = inside.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).join(groups, "grp").select("grp", "n", "step", "k", F.explode(F.arrays_zip("prefix", "places")).alias("p"))
        held = held.select("grp", "n", "step", "k", F.col("p.prefix").alias("gram"), F.col("p.places").alias("place"))
        crowd = held.groupBy("gram").agg(F.sum("k").alias("m")).where("m > 1")
        held = materialize(held.join(crowd, "gram"), "join-held")
        hot = _tied(held.where(F.col("m") > few).select("gram", "step", "grp"))
        pairs = group_pairs(held.where(F.col("m") <= few).select("gram", "place", "grp", "n", "k"), hot, percent)
        links.append(_pair_links(pairs, inside, percent))
        kept = classes.join(large, "label", "left_anti").select("class", "label", "step", "shingles")
        anew = hot.select(F.col("node").alias("grp"), F.col("label").alias("hot"))
        classes = kept.unionByName(classes.join(large, "label", "left_semi").join(anew, "grp").select("class", F.col("hot").alias("label"), "step", "shingles"))
        classes = materialize(classes, "join-split")
    links.append(_block_links(classes.select("class", "label", "step", "shingles"), percent, chunk))
    found = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    joined = components(found).select(F.col("node").alias("class"), "label")
    # Smallest ids are summed up by class, then by component, so that the rows of a large class are joined once only, by Spark's skew join.
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")).join(joined, "class", "left")
    smallest = least.where("label is not null").groupBy("label").agg(F.min("least").alias("smallest"))
    known = least.join(smallest, "label", "left").select("class", F.coalesce("smallest", "least").alias("component_id"))
    out = rows.where("class is not null").join(known, "class", "left").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _block_links(classes: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links of classes (class, label, step, shingles) of one label, part by part of about `chunk`."""
    steps = materialize(classes.groupBy("label", "step").agg(F.count(F.lit(1)).alias("m")), "join-steps")
    after = steps.select("label", (F.col("step") - 1).alias("step"), F.col("m").alias("m_next"))
    steps = steps.join(after, ["label", "step"], "left").withColumn("parts", F.ceil(F.col("m") / chunk).cast("int")).withColumn("parts_next", F.ceil(F.coalesce("m_next", F.lit(0)) / chunk).cast("int"))
    steps = materialize(steps, "join-parts")  # a table, so that Spark can split a large label in the joins with it
    part = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    # A class sits in the pairs of its own step (p <= q) and, as the larger one, in those with the step before it.
    here = classes.select("class", "label", "step").join(steps.where("m > 1 or m_next > 0").select("label", "step", "m", "parts", "parts_next"), ["label", "step"])
    here = here.withColumn("p", part(F.col("parts")))
    below = steps.where("m_next > 0").select("label", "step", "parts", F.col("parts_next").alias("own"))
    there = classes.select("class", "label", (F.col("step") - 1).alias("step")).join(below, ["label", "step"]).withColumn("q", part(F.col("own")))
    ring = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("p", k).alias("p"), F.greatest("p", k).alias("q"), (F.col("p") > k).cast("int").alias("side")))
    cross = F.transform(F.sequence(F.lit(0), F.col("parts_next") - 1), lambda k: F.struct(F.col("p"), (-1 - k).alias("q"), F.lit(0).alias("side")))
    some = lambda c, n: F.when(n > 0, c).otherwise(F.array().cast("array<struct<p:int,q:int,side:int>>"))
    seats = here.select("class", "label", "step", F.explode(F.concat(some(ring, F.when(F.col("m") > 1, 1).otherwise(0)), some(cross, F.col("parts_next")))).alias("s"))
    theirs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(k.alias("p"), (-1 - F.col("q")).alias("q"), F.lit(1).alias("side")))
    seats = seats.unionByName(there.select("class", "label", "step", F.explode(theirs).alias("s")))
    dealt = seats.select("class", "label", "step", "s.p", "s.q", "s.side").join(classes.select("class", "shingles"), "class")

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        p, q = key[2].as_py(), key[3].as_py()
        sets = [np.frombuffer(d, np.uint64) for d in table.column("shingles").to_pylist()]
        sides = None if p == q else table.column("side").to_numpy().astype(np.int8)
        links = verified_links(table.column("class").to_pylist(), sets, percent, sides)
        return pa.table([pa.array([k[i] for k in links], pa.string()) for i in (0, 1)], names=["a", "b"])

    return dealt.groupBy("label", "step", "p", "q").applyInArrow(verify, "a string, b string")
