"""Word n-grams by hash, and their exchange between blocks of documents and shards of n-grams.

Documents are dealt into blocks, n-grams into shards. A block sends each shard one sorted binary list of the distinct n-grams
it holds there, with counts; the shard merges the lists of all blocks and answers each with one code list in the same
order. Rows are few and large, so a corpus of T tokens costs a few bytes a token and no row per token.
Both numbers grow with the input, so blocks, shards and lists stay bounded.

Words are hashed by a polynomial of random values of their bytes, over whole arrays of texts at once. Hashes have 64 bits: the
lowest 24 choose the shard and the highest ones are sent: 48 of words, whose counts have to be exact (with the shard's bits two
of five million words collide with a probability of 1 in 1,000), 40 of shingles, of which two of a million share a hash with a
probability of about 1 in 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW = np.uint64(0xFFFFFF)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_VALUES = np.random.default_rng(61).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLDED]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _POWERS[k] = out
    return _POWERS


def _final(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    return h


def _run_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in UTF-8 bytes, and where they begin; no word crosses a place of starts."""
    solid = ~_BLANK[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    before[inner], after[inner - 1] = False, False
    a, b = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after)
    up, down = _powers(len(data))
    total = np.cumsum(_VALUES[data] * up[: len(data)])
    h = total[b]
    h[a > 0] -= total[a[a > 0] - 1]
    return _final(h * down[a]), a


def hashed_words(texts: pa.Array, run: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where the words of each text begin (one more place than texts).

    Words are maximal runs without ASCII white space, A-Z lower-cased; null has none. Bytes go in runs that end between words.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    _, places, body = texts.buffers()
    edges = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    hashes, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end, reach = len(data), run
        while at + reach < len(data):
            gaps = np.flatnonzero(_BLANK[data[at : at + reach]])
            first, last = np.searchsorted(edges, at, "right"), np.searchsorted(edges, at + reach, "right") - 1
            cut = max(int(gaps[-1]) + 1 if len(gaps) else 0, int(edges[last]) - at if last >= first else 0)
            if cut:
                end = at + cut
                break
            reach *= 2  # a word longer than the run
        lo, hi = np.searchsorted(edges, at, "left"), np.searchsorted(edges, end, "right")
        h, a = _run_hashes(data[at:end], edges[lo:hi] - at)
        hashes.append(h)
        begins.append(a + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), edges)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    h = (a * _MIX[0]) ^ ((b << np.uint64(31)) | (b >> np.uint64(33))) * _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h & LOW) * np.uint64(shards)) >> np.uint64(24)).astype(np.int32)


def in_blocks(docs: DataFrame, block_bytes: int, shard_tokens: int) -> tuple[DataFrame, int]:
    """(doc_id, text, block) and the number of shards. doc_id stays a string if it is one, else it becomes a long.

    The sizes given are least sizes. With T tokens in all, a block or shard grows to 10 * sqrt(T) tokens, so that a list from
    a block to a shard holds some 100 n-grams at any scale (16 million tokens, about 1.5 GB of a task, for 10 TB of text).
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = (size["b"] or 0) + 16 * size["n"]
    grown = int(10 * (total / 6) ** 0.5)
    block_bytes, shard_tokens = max(block_bytes, 6 * grown), max(shard_tokens, grown)
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total // (6 * shard_tokens)))
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    block = F.pmod(key, F.lit(blocks)).cast("int")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").cast("string" if kind == "string" else "long").alias("doc_id"), F.col("text").cast("string").alias("text"), block.alias("block")), min(shards, 1 << 20)


def sort_order(values: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """The order by shard, then value."""
    order = np.argsort(values)
    s = shard[order]
    return order[np.argsort(s.astype(np.uint16) if len(s) and s.max() < 1 << 16 else s, kind="stable")]


def pack(values: np.ndarray, width: int) -> bytes:
    """Sorted values of `width` bytes: byte planes of the low bits, and of the steps between the highest 24, of which the upper planes are compressed."""
    low = 8 * width - 24
    steps = np.diff(values >> np.uint64(low), prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    upper = zstandard.compress(np.ascontiguousarray(steps[:, 1:].T).tobytes(), 3)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width - 3]
    return len(upper).to_bytes(4, "little") + upper + steps[:, 0].tobytes() + np.ascontiguousarray(raw.T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    size = 4 + int.from_bytes(data[:4], "little")
    steps, planes = np.frombuffer(zstandard.decompress(data[4:size]), np.uint8).reshape(3, -1), np.frombuffer(data, np.uint8, offset=size).reshape(width - 2, -1)
    top = np.zeros((planes.shape[1], 4), np.uint8)
    top[:, 0], top[:, 1:] = planes[0], steps.T
    raw = np.zeros((planes.shape[1], 8), np.uint8)
    raw[:, : width - 3] = planes[1:].T
    return (np.cumsum(top.view("<u4").reshape(-1), dtype=np.uint64) << np.uint64(8 * width - 24)) | raw.view("<u8").reshape(-1)


def squeeze(values: np.ndarray) -> bytes:
    """Rows of small integers, mostly equal, as compressed byte planes."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), -1).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def expand(data: bytes, kind: str, columns: int = 1) -> np.ndarray:
    dtype = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(dtype.itemsize * columns, -1)
    out = np.ascontiguousarray(planes.T).view(dtype)
    return out if columns > 1 else out.reshape(-1)


def count_code(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 128, then in steps of a fifth of a power of two."""
    c = np.maximum(counts.astype(np.float64), 1)
    return np.where(counts < 128, counts, np.minimum(255, 128 + np.round(5 * (np.log2(c) - 7)))).astype(np.uint8)


COUNT_OF = np.concatenate([np.arange(128.0), 2.0 ** (7 + np.arange(128) / 5)])
