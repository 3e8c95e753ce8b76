"""Elias-Fano sequences that are searched as they lie, and the trie levels made of them, in memory-mapped files."""

from __future__ import annotations

import os
import tempfile

import numpy as np


def _nth_bit(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit (from 0) of each 64-bit word, by halves."""
    x, n, at = x.copy(), n.astype(np.int64), np.zeros(len(x), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
        up = n >= below
        n -= np.where(up, below, 0)
        at += np.where(up, width, 0)
        x >>= np.where(up, width, 0).astype(np.uint64)
    return at


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high bits in unary, and the ones before each word of these.

    For n values below u this takes about n * (3 + log2(u / n)) bits. Nothing is decoded to search it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.low, self.high, self.ones

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        v = values.astype(np.uint64)
        bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        words = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            low = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[first]] |= np.bitwise_or.reduceat(low << shift, first)
            over = np.flatnonzero(shift + np.uint64(bits) > 64)  # at most one value runs over the end of each word
            words[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((n + (int(universe) >> bits) + 2 + 63) // 64 * 64, np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64) - np.bitwise_count(high)
        return cls(n, bits, words, high, ones.astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = self.low[word] >> shift
        part |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return part & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at some places."""
        i = i.astype(np.int64)
        w = np.searchsorted(self.ones, i, "right") - 1
        place = 64 * w + _nth_bit(self.high[w], i - self.ones[w])
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _begin(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below h."""
        zero = np.maximum(h, 1) - 1  # the zero that ends the values before
        before = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones
        w = np.searchsorted(before, zero, "right") - 1
        place = 64 * w + _nth_bit(~self.high[w], zero - before[w])
        return np.where(h > 0, place - zero, 0)

    def successor(self, queries: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the place of the first value not below it (in begin:end where given), and whether they are equal."""
        q = queries.astype(np.uint64)
        h = (q >> np.uint64(self.low_bits)).astype(np.int64)
        rest = q & np.uint64((1 << self.low_bits) - 1)
        a, b = self._begin(h), self._begin(h + 1)
        if begin is not None:
            a, b = np.clip(a, begin, end), np.clip(b, begin, end)
        last = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            below = self._low(mid) < rest[live]
            a[live], b[live] = np.where(below, mid + 1, a[live]), np.where(below, b[live], mid)
            live = live[a[live] < b[live]]
        hit = np.zeros(len(q), bool)
        inside = np.flatnonzero(a < last)
        hit[inside] = self._low(a[inside]) == rest[inside]
        return a, hit

    def size_in_bytes(self) -> int:
        return sum(x.nbytes for x in self.arrays)


def _mapped(arrays: list[np.ndarray], folder: str | None) -> list[np.ndarray]:
    """The arrays in one file that is mapped, not read; the file's name is gone at once, the mapping keeps the data."""
    handle, path = tempfile.mkstemp(suffix=".trie", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            places = []
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                places.append(f.tell())
                f.write(a.tobytes())
            f.write(b"\0" * 8)
        mapped = np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)
    return [np.asarray(mapped[p : p + a.nbytes]).view(a.dtype) for p, a in zip(places, arrays, strict=True)]


class WordShard:
    """The level of single words.

    words    Elias-Fano of the sorted word hashes
    counts   Elias-Fano of how many tokens the words before each have: exact counts as differences
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, bits: int = 48, folder: str | None = None):
        sums = np.r_[0, np.cumsum(counts)]
        levels = [EliasFano.encode(words, 1 << bits), EliasFano.encode(sums, int(sums[-1]) + 1)]
        views = _mapped([a for e in levels for a in e.arrays], folder)
        self.words, self.counts = (EliasFano(e.n, e.low_bits, *views[3 * k : 3 * k + 3]) for k, e in enumerate(levels))

    def look_up(self, words: np.ndarray) -> np.ndarray:
        """Counts of words; 0 where absent."""
        out = np.zeros(len(words), np.int64)
        at, hit = self.words.successor(words)
        out[hit] = (self.counts.get(at[hit] + 1) - self.counts.get(at[hit])).astype(np.int64)
        return out


class TrieShard:
    """Two levels below a context hash: contexts, and the words that follow them.

    contexts   Elias-Fano of the sorted context hashes, with a back-off code each
    pointers   Elias-Fano of where each context's words begin
    words      Elias-Fano of context number * 2**word_bits + word hash: relative to the context, so the level is monotone
    A context is found by successor search, its words lie between two pointers, and a second successor search between
    these finds a word. Codes are one byte.
    """

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, words: np.ndarray, backoff: np.ndarray, count: np.ndarray, prob: np.ndarray, context_bits: int = 36, word_bits: int = 28, folder: str | None = None):
        n, self.word_bits = len(contexts), np.uint64(word_bits)
        pointers = np.r_[starts, len(words)]
        context_of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(pointers).astype(np.int64)) if n else np.zeros(0, np.uint64)
        levels = [EliasFano.encode(contexts, 1 << context_bits), EliasFano.encode(pointers, len(words) + 1), EliasFano.encode((context_of << self.word_bits) | words, max(1, n) << word_bits)]
        views = _mapped([a for e in levels for a in e.arrays] + [backoff, count, prob], folder)
        self.contexts, self.pointers, self.words = (EliasFano(e.n, e.low_bits, *views[3 * k : 3 * k + 3]) for k, e in enumerate(levels))
        self.backoff, self.count, self.prob = views[9:]

    def look_up(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability code, back-off code, context count code) of each (context, word), contexts sorted; 0 where absent."""
        new = np.r_[True, contexts[1:] != contexts[:-1]] if len(contexts) else np.zeros(0, bool)
        group = np.cumsum(new) - 1  # each context is searched once
        at, seen = self.contexts.successor(contexts[new])
        backoff, count = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
        backoff[seen], count[seen] = self.backoff[at[seen]], self.count[at[seen]]
        begin, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begin[seen], end[seen] = self.pointers.get(at[seen]).astype(np.int64), self.pointers.get(at[seen] + 1).astype(np.int64)
        prob = np.zeros(len(contexts), np.uint8)
        where = np.flatnonzero(seen[group])
        g = group[where]
        child, hit = self.words.successor((at[g].astype(np.uint64) << self.word_bits) | words[where], begin[g], end[g])
        prob[where[hit]] = self.prob[child[hit]]
        return prob, backoff[group], count[group]
