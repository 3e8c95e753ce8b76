"""Cost-balanced packing of token sequences.

Each document's ids get an end id and are cut into pieces of at most `length`. A group of about `group_tokens`
tokens of neighbouring documents is packed at a time, so no shuffle is needed and memory is bounded.
A group of T tokens opens ceil(T / length) sequences. Pieces go in descending length to the sequence of lowest cost
(linear plus quadratic: a * n + b * n * n per piece of n ids) that has room; a piece that fits nowhere is
cut to fill the sequence with most room. So the sequences of a group leave less than one `length` empty in all.

Defined results: null text is empty, so it gives the end id alone; repeated rows are packed separately; a null doc_id
stays null; ties of cost go to the lower sequence number, ties of length to the earlier piece; very long
documents span many sequences; an empty table gives no rows; other columns are ignored. sequence_id is
partition number * 2**33 + number in the partition, the same again when a lost task reruns.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quirefold.llm.common import release_memory, small_batches
from quirefold.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((item, start in item, length, sequence, offset) per piece, number of sequences)."""
    pieces, items = [], []
    for k, n in enumerate(lengths):
        items += [(min(capacity, n - at), k, at) for at in range(0, n, capacity)]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    count = -(-sum(lengths) // capacity)
    used = [0] * count
    open_heap = [(0.0, s) for s in range(count)]
    aside: list[tuple[int, float, int]] = []  # (-room, cost, sequence): had no room for a longer piece

    def put(s: int, cost: float, k: int, at: int, n: int) -> None:
        pieces.append((k, at, n, s, used[s]))
        used[s] += n
        if used[s] < capacity:
            heapq.heappush(open_heap, (cost + linear * n + quadratic * n * n, s))

    for n, k, at in items:
        while n:
            while aside and -aside[0][0] >= n:
                _, cost, s = heapq.heappop(aside)
                heapq.heappush(open_heap, (cost, s))
            while open_heap and capacity - used[open_heap[0][1]] < n:
                cost, s = heapq.heappop(open_heap)
                heapq.heappush(aside, (used[s] - capacity, cost, s))
            if open_heap:
                cost, s = heapq.heappop(open_heap)
                put(s, cost, k, at, n)
                break
            room, cost, s = heapq.heappop(aside)
            put(s, cost, k, at, -room)
            at, n = at - room, n + room
    return pieces, count


def pack(docs: DataFrame, vocabulary: str, cut: str = "before_space", end_id: int = 1, length: int = 2048, group_tokens: int = 1_000_000) -> DataFrame:
    """Pieces (SCHEMA): ids are little-endian unsigned 32-bit."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        number = (ctx.partitionId() if ctx else 0) << 33
        ids, streams, tokens = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, streams, tokens
            pieces, count = assign([len(s) // 4 for s in streams], length)
            for i in range(0, len(pieces), 4096):
                part = pieces[i : i + 4096]
                yield pa.record_batch(
                    [
                        pa.array([ids[k] for k, *_ in part], pa.int64()),
                        pa.array([at for _, at, *_ in part], pa.int64()),
                        pa.array([n for _, _, n, *_ in part], pa.int64()),
                        pa.array([streams[k][4 * at : 4 * (at + n)] for k, at, n, *_ in part], pa.binary()),
                        pa.array([len(streams[k]) // 4 for k, *_ in part], pa.int64()),
                        pa.array([number + s for *_, s, _ in part], pa.int64()),
                        pa.array([o for *_, o in part], pa.int64()),
                    ],
                    schema=_ARROW,
                )
            number += count
            ids, streams, tokens = [], [], 0

        coder = encoder(vocabulary, cut)
        for batch in batches:
            keys = iter(batch.column("doc_id").to_pylist())
            for part in coder.encode_array(batch.column("text")):
                for stream, key in zip(part.to_pylist(), keys):  # noqa: B905  keys go on with the next part
                    ids.append(key)
                    streams.append(stream + end)
                    tokens += len(stream) // 4 + 1
                    if tokens >= group_tokens:
                        yield from flush()
        if streams:
            yield from flush()
        release_memory()

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return narrow.mapInArrow(run, SCHEMA)
