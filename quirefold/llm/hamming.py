"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension (1: above 0). Codes are cut into segments; a code within distance
m * (r + 1) - 1 of a query agrees with it in some of the m segments up to r bits. So the search takes r = 0, 1, 2,
..., looks up all segment values at r bits from the query's, verifies the whole distance of what it finds, and stops as soon
as the k-th distance is at most m * (r + 1) - 1: then nothing nearer, nor any tie, can be missing.

Equal codes are one class that keeps its k + 1 smallest ids, cut before the exchange, so a vector that a third of the
rows share costs no more than another. Classes are dealt into index blocks and queries into groups of up to a million, both sent in
rows of bounded size: a task takes in an index block, builds its tables once and streams a group's queries through them, many at a time.
So the index is exchanged once for every million queries. The few best of each block are merged.

Defined results: neighbours are ordered by distance, then id; a row is not its own neighbour, other rows with its code are;
null vectors are neither found nor asked for; null and NaN dimensions count as 0 bits; vectors may be shorter than `bits`, longer ones fail;
null ids are left out; repeated ids count once; fewer than k other rows give fewer neighbours; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialize, shuffle_width, small_batches

#: Codes of which one step of a search verifies the distances, about.
_HITS = 1 << 20
FOUND = "query_code long, code long, distance int, ids array<long>"


def sign_code(vector: Column, bits: int = 64) -> Column:
    """The sign bits of the dimensions as a long; a vector of more than `bits` (64 at most) dimensions fails."""
    whole = F.when(F.size(vector) > bits, F.raise_error(F.lit("a vector has more dimensions than its code has bits")).cast("array<double>")).otherwise(vector.cast("array<double>"))
    places = F.transform(whole, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(vector.isNotNull(), F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


class MultiIndex:
    """Bucket tables of the segments of 64-bit codes."""

    def __init__(self, codes: np.ndarray, first_ids: np.ndarray, segments: int):
        self.codes, self.first_ids, self.m = codes, first_ids, segments
        self.width = 64 // segments
        self.orders, self.starts = [], []
        for s in range(segments):
            v = self._segment(codes, s)
            order = np.argsort(v, kind="stable").astype(np.int32)
            self.orders.append(order)
            self.starts.append(np.searchsorted(v[order], np.arange((1 << self.width) + 1)).astype(np.int32))
        self._masks: dict[int, np.ndarray] = {}

    def _segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def masks(self, r: int) -> np.ndarray:
        """All segment values with r bits."""
        if r not in self._masks:
            self._masks[r] = np.array([sum(1 << b for b in c) for c in combinations(range(self.width), r)], np.int64)
        return self._masks[r]

    def search(self, queries: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance) of the k nearest codes of each query, ties by first id, for all queries together.

        queries: codes as unsigned numbers. bounds: distances beyond which a query wants none. Results are in the order of the queries.
        """
        most = np.full(len(queries), 64, np.int64) if bounds is None else bounds.astype(np.int64)
        k = min(k, len(self.codes))
        within = np.zeros((len(queries), 65), np.int64)  # codes found of each query, by distance
        parts, open_ = [], np.arange(len(queries))
        for r in range(self.width + 1):
            for s in range(self.m):
                values = self._segment(queries[open_], s)[:, None] ^ self.masks(r)[None, :]
                a, n = self.starts[s][values].ravel().astype(np.int64), (self.starts[s][values + 1] - self.starts[s][values]).ravel().astype(np.int64)
                ends, first = np.cumsum(n), 0
                while first < len(n):  # at most _HITS codes at a time, or one bucket
                    last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _HITS, "right")))
                    parts += self._verified(queries, open_, a[first:last], n[first:last], np.arange(first, last) // self.masks(r).size, s, r, most, within)
                    first = last
            reach = self.m * (r + 1) - 1
            done = (within[open_, : min(reach, 64) + 1].sum(1) >= k) | (most[open_] <= reach)
            open_ = open_[~done]
            if not len(open_):
                break
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, at, distance = (np.concatenate(c) for c in zip(*parts, strict=True))
        kth = np.argmax(np.cumsum(within, 1) >= k, axis=1)
        kth[within.sum(1) < k] = 64
        near = distance <= kth[q]
        q, at, distance = q[near], at[near], distance[near]
        order = np.lexsort((self.first_ids[at], distance, q))
        q, at, distance = q[order], at[order], distance[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        return q[nth < k], at[nth < k], distance[nth < k]

    def _verified(self, queries: np.ndarray, asking: np.ndarray, a: np.ndarray, n: np.ndarray, who: np.ndarray, s: int, r: int, most: np.ndarray, within: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The codes of these buckets that no earlier look-up has found, with their whole distances."""
        a, who, n = a[n > 0], who[n > 0], n[n > 0]
        if not len(n):
            return []
        at = self.orders[s][np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].astype(np.int64)
        q = asking[np.repeat(who, n)]
        x = self.codes[at] ^ queries[q]
        # Found here first: earlier segments differ in more than r bits, later ones in r or more.
        new, distance = np.ones(len(x), bool), np.bitwise_count(x).astype(np.int64)
        for t in range(self.m):
            if t != s:
                new &= np.bitwise_count(self._segment(x, t)) >= (r + 1 if t < s else r)
        new &= distance <= most[q]
        q, at, distance = q[new], at[new], distance[new]
        np.add.at(within, (q, distance), 1)
        return [(q, at, distance)] if len(q) else []


def _blocks_met(index: DataFrame, asks: DataFrame, n_index: int, groups: int, run: int, tasks: int) -> DataFrame:
    """(run, grp, i, kind, c, codes, ids): for each run of index blocks and group of queries, the blocks in turn, each followed by the group's queries.

    Index blocks come in rows of bounded size (kind 0), queries likewise (kind 1). A row lies in one partition with its run and group, in this order.
    """
    of_run = F.floor(F.col("i") / run).cast("int").alias("run")
    held = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")).select(of_run, "grp", "i", F.lit(0).alias("kind"), "c", "codes", "ids")
    each = asks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("i"))
    each = each.select(of_run, "grp", "i", F.lit(1).alias("kind"), "c", "codes", F.lit(None).cast("array<array<bigint>>").alias("ids"))
    return held.unionByName(each).repartition(tasks, "run", "grp").sortWithinPartitions("run", "grp", "i", "kind", "c")


def nearest(rows: DataFrame, id_column: str, code: Column, is_query: Column, k: int = 10, segments: int = 4, index_block: int | None = None, query_block: int = 20_000, task_queries: int = 1_000_000) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) for the rows that is_query holds for.

    index_block: codes of a block; query_block: codes of a row of queries; task_queries: queries that meet an index block in one task, so
    the index is exchanged once for every so many.
    """
    coded = rows.select(F.col(id_column).cast("long").alias("id"), code.alias("code"), F.coalesce(is_query, F.lit(False)).alias("q"))
    coded = materialize(coded.where("id is not null and code is not null").distinct(), "codes")
    by_id = Window.partitionBy("code").orderBy("id")
    few = coded.select("id", "code").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    classes = materialize(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "code-classes")
    queries = coded.where("q").select("id", "code")
    asked = queries.select("code").distinct()
    n, m = classes.count(), asked.count()
    width = shuffle_width(rows.sparkSession)
    # Blocks grow with the table up to what a task can hold: each one costs every query a search of its own.
    index_block = index_block or max(200_000, min(1_000_000, -(-n // (2 * width))))
    n_index, n_query = max(1, -(-n // index_block)), max(1, -(-m // query_block))
    # Few index blocks: the queries are dealt to more tasks.
    groups = min(n_query, max(-(-m // task_queries), -(-width // n_index)))
    run = max(1, min(8, n_index * groups // (4 * width)))
    pieces = -(-index_block // 20_000)
    spread = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("code")), F.lit(parts)).cast("int")
    held = classes.withColumn("i", spread(n_index, 1)).withColumn("c", spread(pieces, 2)).groupBy("i", "c").agg(F.sort_array(F.collect_list(F.struct("code", "ids"))).alias("held"))
    held = held.select("i", "c", F.col("held.code").alias("codes"), F.col("held.ids").alias("ids"))
    # Sorted, so that all copies of a row of queries are in the same order, also where a task runs again.
    asks = asked.withColumn("j", spread(n_query, 3)).groupBy("j").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    asks = asks.select((F.col("j") % groups).cast("int").alias("grp"), F.floor(F.col("j") / groups).cast("int").alias("c"), "codes")
    met = _blocks_met(held, asks, n_index, groups, run, max(width, -(-n_index // run) * groups))

    def search(batches):
        kth: dict[int, np.ndarray] = {}  # of the rows of queries of this run and group: k-th distances in the blocks before
        at, pending, index = None, [], None
        for batch in batches:
            runs, grps, blocks, kinds, places = (batch.column(c).to_pylist() for c in ("run", "grp", "i", "kind", "c"))
            for row, (here, block, kind, c) in enumerate(zip(zip(runs, grps, strict=True), blocks, kinds, places, strict=True)):
                if at is None or here != at[0]:
                    kth = {}
                if (here, block) != at:
                    at, pending, index = (here, block), [], None
                codes = batch.column("codes")[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                if kind == 0:
                    pending.append((codes, batch.column("ids")[row].values))
                    continue
                if not pending:
                    continue  # a block without codes
                if index is None:
                    ids = pa.concat_arrays([x for _, x in pending])
                    firsts = ids.flatten().to_numpy(zero_copy_only=False)[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
                    index = MultiIndex(np.concatenate([x for x, _ in pending]).view(np.uint64), firsts, segments)
                bounds = kth.setdefault(c, np.full(len(codes), 64, np.uint8))
                for a in range(0, len(codes), 256):
                    part = codes[a : a + 256]
                    q, found, distance = index.search(part.view(np.uint64), k + 1, bounds[a : a + 256])
                    last = np.bincount(q, minlength=len(part)) > k
                    bounds[a : a + 256][last] = distance[np.searchsorted(q, np.flatnonzero(last), "right") - 1]
                    columns = [pa.array(part[q]), pa.array(index.codes[found].view(np.int64)), pa.array(distance.astype(np.int32)), ids.take(pa.array(found))]
                    yield pa.record_batch(columns, names=["query_code", "code", "distance", "ids"])

    small_batches(rows.sparkSession)
    found = met.mapInArrow(search, FOUND)
    best = F.row_number().over(Window.partitionBy("query_code").orderBy("distance", F.col("ids")[0]))
    kept = found.withColumn("nth", best).where(F.col("nth") <= k + 1).select("query_code", "distance", F.explode("ids").alias("neighbour_id"))
    # k + 1 neighbours of each asked code, then of each asking row without itself
    top = F.row_number().over(Window.partitionBy("query_code").orderBy("distance", "neighbour_id"))
    kept = kept.withColumn("nth", top).where(F.col("nth") <= k + 1)
    both = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query_code")).join(kept, "query_code").where("query_id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbour_id", "distance", "rank")
