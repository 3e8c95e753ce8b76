"""A trigram language model in sharded Elias-Fano tries, fitted and queried over the whole corpus.

p1(z) = (c(z) + 0.1) / (N + 0.1 (V + 1))
p2(z | y) = w c(y z) / c(y) + (1 - w) p1(z)                      (p1 alone where y is unseen)
p3(z | x y) = (c(x y z) - D) / c(x y) + D T(x y) / c(x y) p2(z | y)    (p2 alone where x y is unseen)

with training counts, T the number of distinct words after x y; the sums over the V words and one unknown word are 1. Texts
begin with two start marks and end with an end token, which is counted. Stored probabilities and back-off weights are
quantised to a byte (finer near 1, reaching down to 2**-40), counts of contexts as in grams.count_code.

The trie has three levels: words with exact counts, pairs (the contexts, with back-off and count) and the words behind
them, held in shards. Blocks of documents send their distinct trigrams to shards by the hash of the first two words, and
their distinct words to word shards. A shard merges the training counts, builds its memory-mapped levels, searches them for
what each block sent and answers with codes; then each block is read again and scored, from the same exchange of the
documents. N and V come from a pass of their own. Every n-gram of the corpus counts; no table is sent whole to any task or to
the driver. Within a shard words are known by 48 bits of their hash, contexts by 36 and a context's words by 28.

Defined results: null text is empty and scores its end token; held-out texts are scored, not learnt; without training
rows every token has probability 1 / (0 + 0.1 * 1) * 0.1 = 1; repeated rows each count; an empty table gives no rows; other
columns are ignored; a very long text is scored whole in its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import grams
from quirefold.llm.common import bucket_of, release_memory, small_batches
from quirefold.llm.elias_fano import TrieShard, WordShard

START, END, PAST = (np.uint64(x) for x in (0x51A7, 0xE0D, 0x9A57))
CONTEXT_BITS, WORD_BITS = 36, 28
REACH = 40.0
#: Values of the codes: the negative binary logarithm grows with the square of the code; 0 is absent.
VALUE_OF = np.concatenate([[0.0], 2.0 ** (-REACH * (np.arange(255) / 254) ** 2)])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def value_code(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(1 + np.round(254 * np.sqrt(np.maximum(0.0, -np.log2(np.maximum(p, 1e-300))) / REACH)), 1, 255).astype(np.uint8)


def _keys(table: pa.Table, shards: int):
    """Token hashes of a block (an end behind each text), where each text's begin, and per trigram and per token: (shard, key, 1 if learnt)."""
    words, edges = grams.hashed_words(table.column("text"))
    n = len(edges) - 1
    number = np.repeat(np.arange(n, dtype=np.int32), np.diff(edges) + 1)
    tokens = np.full(len(number), END)
    ends = edges[1:] + np.arange(n)
    is_word = np.ones(len(number), bool)
    is_word[ends] = False
    tokens[is_word] = words
    begins = edges + np.arange(n + 1)
    # Each text as: start, start, tokens, past; its trigrams are one more than its tokens.
    line = np.full(len(tokens) + 3 * n, START)
    line[np.arange(len(tokens)) + 3 * number + 2] = tokens
    line[begins[1:] + 3 * np.arange(1, n + 1) - 1] = PAST
    first = np.arange(len(tokens) + n) + 2 * np.repeat(np.arange(n), np.diff(begins) + 1)
    pair = grams.mix(line[first], line[first + 1])
    learnt = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    last = line[first + 2]
    del line, first, words, is_word
    tri = ((pair >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(WORD_BITS)) | (last >> np.uint64(64 - WORD_BITS))
    return tokens, begins, (grams.shard_of(pair, shards), tri, np.repeat(learnt, np.diff(begins) + 1)), (grams.shard_of(tokens, shards), tokens >> np.uint64(16), learnt[number])


def _distinct(shard: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sort by shard and key, and the starts of its groups."""
    order = grams.sort_order(key, shard)
    s, k = shard[order], key[order]
    return order, np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1])]) if len(k) else np.zeros(0, np.int64)


def _cuts(shard: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal shards."""
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(1, np.int64)
    return edges[:-1].tolist(), edges[1:].tolist()


def training_size(rows: DataFrame, shards: int) -> tuple[int, int]:
    """N and V: tokens and distinct tokens of the training rows (text, held_out). Only sums reach the driver."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = grams.hashed_words(batch.column("text"))
            n = len(words) + batch.num_rows
            h = np.sort(np.r_[words, END])
            h = h[np.r_[True, h[1:] != h[:-1]]]
            shard = grams.shard_of(h, shards)
            order = np.argsort(shard, kind="stable")
            begins, ends = _cuts(shard[order])
            names = [int(shard[order[a]]) for a in begins]
            keys = [grams.pack(h[order[a:b]] >> np.uint64(16), 6) for a, b in zip(begins, ends, strict=True)]
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(keys, pa.binary()), pa.array([n] + [0] * (len(names) - 1), pa.int64())], names=["shard", "keys", "n"])

    def count(table: pa.Table) -> pa.Table:
        every = np.sort(np.concatenate([grams.unpack(d, 6) for d in table.column("keys").to_pylist()]))
        v = 1 + int((every[1:] != every[:-1]).sum())
        return pa.table([pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([v], pa.int64())], names=["n", "v"])

    sent = rows.where("not held_out").select("text").mapInArrow(distinct, "shard long, keys binary, n long")
    total = sent.groupBy("shard").applyInArrow(count, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return int(total["n"] or 0), int(total["v"] or 0)


def score(docs: DataFrame, held_out: Column, discount: float = 0.8, pair_weight: float = 0.2, block_bytes: int = 5_000_000, shard_tokens: int = 500_000) -> DataFrame:
    """SCORED rows. held_out: a condition on doc_id and text; those rows are scored but not learnt."""
    small_batches(docs.sparkSession)
    rows, shards = grams.in_blocks(docs, block_bytes, shard_tokens)
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    grouped = rows.groupBy("block")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        release_memory()  # what the group before has freed
        block = key[0].as_py()
        _, _, tri, uni = _keys(table, shards)
        out = []
        for kind, width, (shard, k, weight) in ((3, 8, tri), (1, 6, uni)):
            order, first = _distinct(shard, k)
            counts = np.add.reduceat(weight[order].astype(np.uint32), first, dtype=np.uint32)
            s, k = shard[order[first]], k[order[first]]
            for a, b in zip(*_cuts(s), strict=True):
                out.append((kind, int(s[a]), block, grams.pack(k[a:b], width), grams.squeeze(counts[a:b])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "shard", "block", "keys", "counts"])

    sent = grouped.applyInArrow(send, "kind int, shard long, block int, keys binary, counts binary")

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        release_memory()
        kind, shard = key[0].as_py(), key[1].as_py()
        blocks = table.column("block").to_pylist()
        lists = [grams.unpack(d, 8 if kind == 3 else 6) for d in table.column("keys").to_pylist()]
        counts = np.concatenate([grams.expand(d, "<u4") for d in table.column("counts").to_pylist()]).astype(np.int64)
        every = np.concatenate(lists)
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        keys, total = every[first], np.add.reduceat(counts[order], first)
        del every, order, counts
        learnt = total > 0
        k, c = keys[learnt], total[learnt]
        if kind == 1:
            found = WordShard(k, c).look_up(keys)
        else:
            context = k >> np.uint64(WORD_BITS)
            begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(k) else np.zeros(0, np.int64)
            each = np.diff(np.r_[begin, len(k)])
            whole = np.add.reduceat(c, begin) if len(k) else np.zeros(0, np.int64)
            prob = value_code((c - discount) / np.repeat(whole, each))
            low = np.uint64((1 << WORD_BITS) - 1)
            trie = TrieShard(context[begin], begin, k & low, value_code(discount * each / np.maximum(whole, 1)), grams.count_code(whole), prob, CONTEXT_BITS, WORD_BITS)
            found = np.stack(trie.look_up(keys >> np.uint64(WORD_BITS), keys & low), 1)
        codes = [grams.squeeze(found[np.searchsorted(keys, q)]) for q in lists]
        size = len(blocks)
        return pa.table([pa.array([kind] * size, pa.int32()), pa.array([shard] * size, pa.int64()), pa.array(blocks, pa.int32()), pa.array(codes, pa.binary())], names=["kind", "shard", "block", "codes"])

    answers = sent.groupBy("kind", "shard").applyInArrow(answer, "kind int, shard long, block int, codes binary")
    n_train, v_train = training_size(rows, shards)
    floor = n_train + 0.1 * (v_train + 1)

    def combine(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        release_memory()
        tokens, begins, tri, uni = _keys(table, shards)
        replies = {(k, s): c for k, s, c in zip(got.column("kind").to_pylist(), got.column("shard").to_pylist(), got.column("codes").to_pylist(), strict=True)}

        def gather(kind: int, shard: np.ndarray, k: np.ndarray, read) -> np.ndarray:
            order, first = _distinct(shard, k)
            s = shard[order[first]]
            parts = np.concatenate([read(replies[kind, int(s[a])]) for a in _cuts(s)[0]])
            out = np.empty((len(k), *parts.shape[1:]), parts.dtype)
            out[order] = np.repeat(parts, np.diff(np.r_[first, len(k)]), axis=0)
            return out

        codes = gather(3, *tri[:2], lambda d: grams.expand(d, "u1", 3))
        del tri
        c = gather(1, *uni[:2], lambda d: grams.expand(d, "<i8")).astype(np.float64)
        del uni, replies
        n = len(begins) - 1
        size = np.diff(begins)
        at = np.arange(len(tokens)) + np.repeat(np.arange(n), size)  # of a token's own trigram; the next one has it as second word
        p1 = (c + 0.1) / floor
        before = np.r_[0.0, c[:-1]]
        before[begins[:-1]] = c[begins[1:] - 1]  # the start mark was seen as often as the end
        pairs = grams.COUNT_OF[codes[at + 1, 2]]
        p2 = np.where(before > 0, pair_weight * np.minimum(1.0, pairs / np.maximum(before, 1)) + (1 - pair_weight) * p1, p1)
        own, back = VALUE_OF[codes[at, 0]], codes[at, 1]
        p3 = np.where(back > 0, own + VALUE_OF[back] * p2, p2)
        known, base, score = (np.add.reduceat(x, begins[:-1]) for x in ((c > 0).astype(np.int64), np.log10(p1), np.log10(np.minimum(p3, 1.0))))
        columns = (table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), size, known, np.full(n, n_train), base, score)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) if isinstance(x, np.ndarray) else x.cast(t) for x, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCORED.split(", ")])

    return grouped.cogroup(answers.select("kind", "shard", "block", "codes").groupBy("block")).applyInArrow(combine, SCORED)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores learnt from the rows whose crc32(doc_id as text) mod 10 is not 0."""
    return score(docs, bucket_of(F.col("doc_id"), 10) == 0)
