"""Phrase mining: frequent phrases of 2 to 5 words per language, scored by their weakest cut, without those that a longer one explains.

1. Documents are packed, as they are read, into blocks of a few megabytes of lower-cased text, equal texts of a block once with
   their number. Blocks are a written table and follow no key, so copies and large sources weigh on no task.
2. First pass: every block adds its phrases to count-min sketches of two rows, words and pairs to the first, longer phrases whose
   pairs have survived that to the second. A sketch's width grows with the corpus and is cut into slices; a block sends each slice
   the counters it touches, a slice adds up the lists of all blocks and tells each block which of its counters reach the
   threshold. A counter is never below the count of a phrase in it, so no frequent phrase is lost.
3. Second pass: every block counts its survivors again and passes them on as text with exact counts, in a list for each of 64
   shards. Lists of up to 512 blocks are added up at once, their sums by Spark. False survivors fall out here.
4. Cuts are looked up by two joins; scores are integral quotients of 38-digit numbers. Phrases inside a longer one with the same
   count go; what is left is ranked per language, only the best of each task being exchanged.

Words: pieces are cut at `[.,;:!?\\x0A-\\x0D]`, words at blanks and tabs; only A-Z is lower-cased. Within a block, phrases are told
apart by numbers of their words, not by hashes; hashes choose counters only.

Defined results: null and empty texts have no words; null lang is `und`, as is that name itself; an empty table gives no rows;
repeated rows count each time; doc_id and other columns are not read; a long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import grams
from quirefold.llm.common import materialize, release_memory, small_batches

ROWS = 2  # of a sketch
SHARDS, TOGETHER = 64, 512
_KIND = np.zeros(256, np.uint8)  # 1: blank, 2: end of a piece
_KIND[[0x09, 0x20]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_SEEDS = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93], np.uint64)
BLOCK = "block long, n_bytes long, body binary"
COUNTS = "lang string, n_words int, phrase string, f long"


def _packer(block_bytes: int):
    """Batches of (lang, text) to blocks: Arrow tables of distinct (lang, text) with their number, compressed."""

    def row(number: int, tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).group_by(["lang", "text"]).aggregate([([], "count_all")])
        block = (TaskContext.get().partitionId() << 32) | number
        size = pc.sum(pc.binary_length(table["text"])).as_py()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([_bytes(table)], pa.binary())], names=["block", "n_bytes", "body"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            table = pa.table([batch["lang"].cast(pa.large_string()), batch["text"].cast(pa.large_string())], names=["lang", "text"])
            ends = np.cumsum(pc.binary_length(table["text"]).to_numpy())
            at = 0
            while at < len(ends):
                begun = int(ends[at - 1]) if at else 0
                stop = min(len(ends), max(at + 1, int(np.searchsorted(ends, begun + block_bytes - size, "right"))))
                held.append(table.slice(at, stop - at))
                size += int(ends[stop - 1]) - begun
                at = stop
                if size >= block_bytes or at < len(ends):
                    yield row(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield row(number, held)

    return pack


class Phrases:
    """The distinct phrases of a block, length by length: count, hash, first place; words of lengths follow one another."""

    def __init__(self, body: bytes):
        table = pa.ipc.open_stream(body).read_all().combine_chunks()
        texts = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
        lang = pc.dictionary_encode(table["lang"].combine_chunks())
        self.langs = lang.dictionary.to_pylist()
        _, places, data = texts.buffers()
        edges = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        kind = _KIND[data]
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = kind == 0
        begin, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = edges[(edges > 0) & (edges < len(data))]
        begin[inner] = solid[inner + 1]
        last[inner - 1] = solid[inner]
        a, b = np.flatnonzero(begin), np.flatnonzero(last) + 1
        del begin, last, solid
        text = np.searchsorted(edges, a, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int64)[a] + text
        del kind
        # A piece's number grows with every break and every text, so equal numbers are one piece of one text.
        joined = piece[1:] == piece[:-1]
        del piece
        weights = table["count_all"].to_numpy()[text]
        of_lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
        del text
        k = len(a)
        places = np.empty(2 * k, np.int64)
        places[0::2], places[1::2] = a, b
        strings = pa.Array.from_buffers(pa.large_binary(), max(0, 2 * k - 1), [None, pa.py_buffer(places), pa.py_buffer(data)])
        coded = strings.dictionary_encode()  # of words and, between them, of gaps
        code = coded.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)
        self.code, self.words = code, coded.dictionary
        n = len(self.langs)
        ids, base = pd.factorize(code * n + of_lang)
        hashes, starts = grams.hashed_words(self.words.cast(pa.large_string()))
        salt = np.array([xxhash.xxh64(x.encode()).intdigest() for x in self.langs], np.uint64)
        base = base.astype(np.int64)
        one = grams.mix(hashes[starts[base // n]], salt[base % n]) if k else np.zeros(0, np.uint64)
        self.total = np.bincount(of_lang, weights, len(self.langs)).astype(np.int64)
        self.lang_of_word = of_lang
        self.joined, self.ids, self.at = joined, ids, ids
        weights = None if weights.max(initial=0) == 1 else weights
        self.weights, self.one = weights, one
        #: For each length: hashes, counts and first places of its phrases, and the numbers of the phrases one word shorter in them.
        self.levels = [self._level(ids, np.arange(k), one, None)]
        self.alive: list[np.ndarray] = []

    def _level(self, ids: np.ndarray, place: np.ndarray, h: np.ndarray, before: np.ndarray | None) -> tuple:
        count = np.bincount(ids, None if self.weights is None else self.weights[place], len(h)).astype(np.int64)
        first = np.zeros(len(h), np.int32)
        first[ids[::-1]] = place[::-1]
        parts = (None, None) if before is None else (before[first].astype(np.int32), before[first + 1].astype(np.int32))
        return h, count, first, *parts

    def grow(self, longest: int) -> None:
        """Adds the phrases of up to `longest` words whose parts are there."""
        n = max(1, len(self.one))
        for m in range(len(self.levels) + 1, longest + 1):
            before = self.at
            there = (before[:-1] >= 0) & (before[1:] >= 0)
            place = np.flatnonzero(there & self.joined if m == 2 else there)
            ids, pairs = pd.factorize(before[place] * n + self.ids[place + (m - 1)])
            h = grams.mix(self.levels[-1][0][pairs // n], self.one[pairs % n])
            self.levels.append(self._level(ids, place, h, before))
            self.at = np.full(len(before), -1, np.int64)
            self.at[place] = ids

    def narrow(self, marks: np.ndarray) -> None:
        """Marks of the phrases of the lengths that have none yet; one stays if both of its parts do too."""
        at = 0
        for h, _, _, prefix, suffix in self.levels[len(self.alive) :]:
            mark = marks[at : at + len(h)]
            at += len(h)
            self.alive.append(mark if prefix is None else mark & self.alive[-1][prefix] & self.alive[-1][suffix])
        if len(self.at):
            self.at = np.where((self.at >= 0) & np.append(self.alive[-1], False)[self.at], self.at, -1)

    def unmarked(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of the phrases without marks."""
        new = self.levels[len(self.alive) :]
        return np.concatenate([x[0] for x in new]), np.concatenate([x[1] for x in new])

    def chosen(self) -> pa.Table:
        """COUNTS of the phrases that stay, and, as of 0 words, of all words of a language."""
        names = pa.array(self.langs, pa.string())
        langs, sizes, texts, counts = [names], [np.zeros(len(names), np.int32)], [pa.array([""] * len(names), pa.string())], [self.total]
        for m, ((_, count, first, _, _), mark) in enumerate(zip(self.levels, self.alive, strict=True), 1):
            some = np.flatnonzero(mark)
            parts = [self.words.take(pa.array(self.code[first[some] + j])).cast(pa.string()) for j in range(m)]
            texts.append(parts[0] if m == 1 else pc.binary_join_element_wise(*parts, " "))
            langs.append(names.take(pa.array(self.lang_of_word[first[some]])))
            sizes.append(np.full(len(some), m, np.int32))
            counts.append(count[some])
        return pa.table([pa.concat_arrays(langs), pa.array(np.concatenate(sizes)), pa.concat_arrays(texts), pa.array(np.concatenate(counts))], names=["lang", "n_words", "phrase", "f"])


def _counters(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (grams.mix(hashes, _SEEDS[row : row + 1]) % np.uint64(width)).astype(np.int64)


def _squeeze(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _table(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Sketch:
    """A count-min sketch of `width` counters a row, in slices, of the phrases up to a length; counters stop at the threshold."""

    def __init__(self, longest: int, width: int, min_count: int):
        self.longest, self.width, self.min_count = longest, width, min_count
        # Lists get shorter as the corpus grows, slices larger, within 512 MB of a task.
        self.piece = min(1 << 27, max(1 << 18, int(200 * width**0.5)))
        self.slices = -(-width // self.piece)
        self.kind = "<u4" if min_count > 255 else "u1"

    def touched(self, found: Phrases, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counters touched in order, where each phrase's counter stands among them, their sums, and the cuts between slices."""
        hashes, counts = found.unmarked()
        at = _counters(hashes, row, self.width)
        order = np.argsort(at)
        at = at[order]
        new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        own, where = at[new], np.empty(len(at), np.int32)
        where[order] = np.cumsum(new, dtype=np.int32) - 1
        del at, order, new
        sums = np.minimum(np.bincount(where, counts, len(own)), self.min_count).astype(self.kind)
        return own, where, sums, np.searchsorted(own, np.arange(self.slices + 1) * self.piece)

    def lists(self, found: Phrases, block: int) -> pa.Table:
        """What a block sends: one row for each slice that it touches."""
        out = []
        for row in range(ROWS):
            own, _, sums, cuts = self.touched(found, row)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = own[cuts[s] : cuts[s + 1]]
                steps = np.diff(part, prepend=s * self.piece).astype("<u4")
                out.append((row * self.slices + s, block, len(part), _squeeze(steps), _squeeze(sums[cuts[s] : cuts[s + 1]])))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["slice", "block", "n", "steps", "sums"])

    def merged(self, table: pa.Table) -> pa.Table:
        """A slice's answer to each of its blocks: which of its counters reach the threshold."""
        release_memory()
        held, size = np.zeros(self.piece, np.uint32), np.dtype(self.kind).itemsize

        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for steps, sums in zip(table["steps"], table["sums"], strict=True):
                raw = np.frombuffer(zstandard.decompress(steps.as_py()), np.uint8).reshape(4, -1)
                added = np.frombuffer(zstandard.decompress(sums.as_py()), np.uint8).reshape(size, -1)
                yield np.cumsum(np.ascontiguousarray(raw.T).view("<u4").reshape(-1), dtype=np.int64), np.ascontiguousarray(added.T).view(self.kind).reshape(-1)

        for at, added in each():
            held[at] = np.minimum(held[at] + added.astype(np.uint32), self.min_count)
        marks = [zstandard.compress(np.packbits(held[at] >= self.min_count).tobytes(), 1) for at, _ in each()]
        return pa.table([table["slice"], table["block"], table["n"], pa.array(marks, pa.binary())], names=["slice", "block", "n", "marks"])

    def marks(self, found: Phrases, got: pa.Table) -> np.ndarray:
        """Which unmarked phrases reach the threshold in all rows of the sketch."""
        replies = {s: np.unpackbits(np.frombuffer(zstandard.decompress(m.as_py()), np.uint8), count=n).astype(bool) for s, n, m in zip(got["slice"].to_pylist(), got["n"].to_pylist(), got["marks"], strict=True)}
        alive = None
        for row in range(ROWS):
            _, where, _, _ = self.touched(found, row)
            mine = [replies[s] for s in range(row * self.slices, (row + 1) * self.slices) if s in replies]
            mark = np.concatenate(mine)[where] if mine else np.zeros(len(where), bool)
            alive = mark if alive is None else alive & mark
        return alive


def count_phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, block_bytes: int = 6 << 20, load: int = 20) -> DataFrame:
    """COUNTS of all phrases of 1 to `longest` words that occur min_count times or more in a language; n_words 0: all its words.

    load: the phrases (each time they occur) that share a counter, on average.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    blocks = materialize(rows.mapInArrow(_packer(block_bytes), BLOCK), "phrase-blocks")
    size = blocks.agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    width = lambda lengths: max(1 << 16, (size["bytes"] or 0) * lengths // (6 * load))
    short = Sketch(min(2, longest), width(min(2, longest)), min_count)
    sketches = [short] + ([Sketch(longest, width(longest - 2), min_count)] if longest > 2 else [])
    bodies = blocks.select("block", "body").groupBy("block")
    lists, marks = "slice long, block long, n int, steps binary, sums binary", "slice long, block long, n int, marks binary"

    def replayed(table: pa.Table, got: pa.Table, upto: int) -> Phrases:
        """A block's phrases after the answers of the first `upto` sketches."""
        found = Phrases(table["body"][0].as_py())
        for k, sketch in enumerate(sketches[:upto]):
            found.grow(sketch.longest)
            found.narrow(sketch.marks(found, got.filter(pc.equal(got["sketch"], k))))
        return found

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch["block"].to_pylist(), batch["body"], strict=True):
                release_memory()
                found = Phrases(body.as_py())
                found.grow(short.longest)
                table, found = short.lists(found, block), None
                yield from table.to_batches(max_chunksize=64)

    def later(k: int):
        def send(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
            release_memory()
            found = replayed(table, got, k)
            found.grow(sketches[k].longest)
            return sketches[k].lists(found, key[0].as_py())

        return send

    def merged(sketch: Sketch):
        return lambda table: sketch.merged(table)

    answers = None
    for k, sketch in enumerate(sketches):
        sent = blocks.select("block", "body").mapInArrow(first, lists) if k == 0 else bodies.cogroup(answers.groupBy("block")).applyInArrow(later(k), lists)
        got = materialize(sent.groupBy("slice").applyInArrow(merged(sketch), marks).withColumn("sketch", F.lit(k)), "phrase-answers")
        answers = got if answers is None else answers.unionByName(got)

    # A block deals its counts to SHARDS lists; lists of up to TOGETHER blocks are added up at once, then rows.
    groups = max(1, -(-size["n"] // TOGETHER))

    def second(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        release_memory()
        found = replayed(table, got, len(sketches)).chosen()
        shard = np.array([xxhash.xxh32_intdigest(x) % SHARDS for x in found["phrase"].to_pylist()], np.int64)
        group = hash(key[0].as_py()) % groups
        lists = [(group * SHARDS + int(s), _bytes(found.filter(pa.array(shard == s)))) for s in np.unique(shard)]
        return pa.table([pa.array([r[0] for r in lists], pa.int64()), pa.array([r[1] for r in lists], pa.binary())], names=["shard", "counts"])

    def together(table: pa.Table) -> pa.Table:
        release_memory()
        held, limit = None, 1 << 18
        for part in table["counts"]:
            part = _table(part.as_py())
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows > limit:
                held = _summed(held)
                limit = 2 * held.num_rows + (1 << 18)
        return _summed(held)

    dealt = bodies.cogroup(answers.groupBy("block")).applyInArrow(second, "shard long, counts binary")
    counts = dealt.groupBy("shard").applyInArrow(together, COUNTS).groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    return materialize(counts.where((F.col("n_words") == 0) | (F.col("f") >= min_count)), "phrase-counts")


def _summed(table: pa.Table) -> pa.Table:
    out = table.group_by(["lang", "n_words", "phrase"]).aggregate([("f", "sum")])
    return out.rename_columns(["lang", "n_words", "phrase", "f"])


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(start), size), " ")


def scored(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, score, k, l, r, n) of the phrases in COUNTS of 2 words and more, without those that a longer one explains.

    score: the least floor(1000 a n / (l r)) of the cuts; exact while 1000 n and all counts are below 10^19.
    """
    words = F.split("phrase", " ")
    found = counts.where("n_words >= 2").withColumnRenamed("f", "a")
    every = counts.where("n_words >= 1")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(words, 1, F.col("k")).alias("left"), _part(words, F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    quotient = F.expr("(cast(a as decimal(19,0)) * cast(1000 * n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cuts = cuts.join(totals, "lang").withColumn("score", quotient.cast("long"))
    out = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    inside = [F.when(F.col("n_words") > j, F.when(F.col("n_words") >= i + j - 1, _part(words, i, F.lit(j)))) for j in range(2, longest) for i in range(1, longest - j + 2)]
    if not inside:
        return out
    within = found.select("lang", F.explode(F.array_distinct(F.array_compact(F.array(*inside)))).alias("phrase"), "a")
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    return out.join(within, ["lang", "phrase"], "left").where("within is null or within < a").drop("within")


def mine(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, **sketch: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 words and more."""
    found = scored(count_phrases(docs, min_count, longest, **sketch), longest)
    # The best of 64 parts of a language first, so that no task sorts all phrases of one.
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    dealt = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("place") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
