"""Content-addressed store of token id streams.

A store is a folder of four Parquet tables:

    chunks    chunk_id (sha256 of the ids), n, payload (the ids, compressed)                     each chunk once
    recipes   part, place, start_in_part, doc_id, n_tokens, chunk_ids, chunk_lengths, doc_root   ascending doc_id
    manifest  part, tokens, documents, part_root                                                 ascending part
    root      parts, tokens, documents, root                                                     one row

A rolling hash of the last 16 ids cuts a stream where its low bits are 0, so an edit moves only nearby cuts and
equal passages share chunks. doc_root hashes the chunk ids of a document; doc_roots are hashed a thousand at a time, those
hashes to part_root, and part_roots to root: a Merkle tree of bounded nodes, by which both readers verify chunks, recipes,
parts and the whole. A chunk, recipe or part that is missing or altered fails the read.

Defined results: null text is empty, its stream is the end id alone; repeated rows and ids are stored apart, in the order
(doc_id, doc_root), null ids first; very long streams are many chunks, none over `longest`; an empty table makes an
empty store; other columns are ignored. A chunk whose bytes do not match its address fails the read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import materialize, release_memory, shared_dir, shuffle_width, small_batches
from quirefold.llm.tokens import encoder

_STAGED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunk_ids", pa.list_(pa.binary())), ("chunk_lengths", pa.list_(pa.int32())), ("doc_root", pa.binary()), ("fresh", pa.list_(pa.binary()))])
_RECIPE = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("start_in_part", pa.int64()), *[_STAGED.field(k) for k in ("doc_id", "n_tokens", "chunk_ids", "chunk_lengths", "doc_root")]])
_CHUNK = pa.schema([("chunk_id", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])
_USE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("place", pa.int32()), ("chunk_id", pa.binary()), ("after", pa.int64())])
_SUM = pa.schema([("chunk_id", pa.binary()), ("n", pa.int32()), ("crc", pa.int64())])


def _gear(size: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)


def _candidates(ids: np.ndarray, gear: np.ndarray, mask: int) -> np.ndarray:
    """Ends of the windows of 16 ids (fewer at the start) whose hash has zero bits under the mask."""
    h = gear[ids & (len(gear) - 1)]
    for k in (1, 2, 4, 8):  # after these, h sums the shifted values of 16 ids
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k) if len(h) > k else 0
        h = more
    return np.flatnonzero((h >> np.uint32(12)) & np.uint32(mask) == 0) + 1


def cut_points(ids: np.ndarray, gear: np.ndarray, shortest: int, mask: int, longest: int) -> list[int]:
    """Ends of the chunks of a stream."""
    return _chunk_ends(len(ids), _candidates(ids, gear, mask).tolist(), shortest, longest)


def cuts_of(streams: list[bytes], gear: np.ndarray, shortest: int, mask: int, longest: int) -> list[list[int]]:
    """cut_points() of each stream. Windows that reach into the stream before end no chunk where chunks are longer than a window."""
    if shortest < 16:
        return [cut_points(np.frombuffer(s, "<u4"), gear, shortest, mask, longest) for s in streams]
    size = np.array([len(s) // 4 for s in streams], np.int64)
    begin = np.cumsum(size) - size
    found = _candidates(np.frombuffer(b"".join(streams), "<u4"), gear, mask)
    a, b = np.searchsorted(found, begin, "right"), np.searchsorted(found, begin + size, "right")
    return [_chunk_ends(n, (found[i:j] - at).tolist(), shortest, longest) for n, at, i, j in zip(size.tolist(), begin.tolist(), a.tolist(), b.tolist(), strict=True)]


def _chunk_ends(n: int, cuts: list[int], shortest: int, longest: int) -> list[int]:
    """Ends of the chunks of n ids with candidates for cuts: none under `shortest` but the last, none over `longest`."""
    ends, last = [], 0
    for c in cuts:
        while c - last > longest:
            last += longest
            ends.append(last)
        if c - last >= shortest:
            ends.append(c)
            last = c
    while n - last > longest:
        last += longest
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def _narrow(body: bytes) -> bytes:
    """ids as 16-bit where they fit."""
    ids = np.frombuffer(body, "<u4")
    return ids.astype("<u2").tobytes() if int(ids.max()) < 1 << 16 else body


def _wide(data: bytes, n: int) -> bytes:
    return data if len(data) == 4 * n else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def write_store(docs: DataFrame, vocabulary: str, cut: str = "white_space", end_id: int = 2, path: str | None = None, shortest: int = 256, mask: int = 1023, longest: int = 4096, part_tokens: int = 50_000_000, part_chunks: int = 500_000) -> str:
    """Writes the store and returns its folder (in the shared folder unless named).

    Files of chunks and parts of recipes grow in number with the data: about part_chunks uses of chunks and part_tokens ids each.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    end = int(end_id).to_bytes(4, "little")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, gear, sent, press = encoder(vocabulary, cut), _gear(), set(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = iter(batch.column("doc_id").to_pylist())
            for part in coder.encode_array(batch.column("text")):
                rows = []
                streams = [ids + end for ids in part.to_pylist()]
                for stream, ends, key in zip(streams, cuts_of(streams, gear, shortest, mask, longest), keys):  # noqa: B905  keys go on with the next part
                    names, lengths, fresh, at = [], [], [], 0
                    for e in ends:
                        body = stream[4 * at : 4 * e]
                        name = hashlib.sha256(body).digest()
                        names.append(name)
                        lengths.append(e - at)
                        if name in sent:
                            fresh.append(None)
                        else:
                            if len(sent) < 200_000:
                                sent.add(name)
                            fresh.append(press.compress(_narrow(body)))
                        at = e
                    rows.append((key, at, names, lengths, hashlib.sha256(b"".join(names)).digest(), fresh))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STAGED, strict=True)], schema=_STAGED)
        release_memory()

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    small_batches(spark)
    staged = materialize(narrow.mapInArrow(chunk, "doc_id long, n_tokens long, chunk_ids array<binary>, chunk_lengths array<int>, doc_root binary, fresh array<binary>"), "staged")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # some `part_chunks` addresses: the exchange has as many parts as the chunks need
        for batch in batches:
            keep = []
            for k, name in enumerate(batch.column("chunk_id").to_pylist()):
                if name not in seen:
                    seen.add(name)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    rows = staged.select(F.explode(F.arrays_zip("chunk_ids", "chunk_lengths", "fresh")).alias("c")).select(F.col("c.chunk_ids").alias("chunk_id"), F.col("c.chunk_lengths").alias("n"), F.col("c.fresh").alias("payload")).where("payload is not null")
    total = staged.agg(F.sum("n_tokens").alias("tokens"), F.sum(F.size("chunk_ids")).alias("chunks")).first()
    tokens, used = total["tokens"] or 0, total["chunks"] or 0
    rows.repartition(shuffle_width(spark, -(-used // part_chunks)), "chunk_id").mapInArrow(once, "chunk_id binary, n int, payload binary").write.option("compression", "none").parquet(f"{path}/chunks")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            starts, places = at + np.cumsum(n) - n, place + np.arange(len(n))
            at, place = at + int(n.sum()), place + len(n)
            yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(places), pa.array(starts), *[batch.column(f.name).cast(f.type) for f in list(_RECIPE)[3:]]], schema=_RECIPE)

    parts = shuffle_width(spark, -(-tokens // part_tokens))
    ordered = staged.drop("fresh").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "doc_root")
    ordered.mapInArrow(number, "part int, place long, start_in_part long, doc_id long, n_tokens long, chunk_ids array<binary>, chunk_lengths array<int>, doc_root binary").write.parquet(f"{path}/recipes")
    _manifest(spark.read.parquet(f"{path}/recipes")).sort("part").write.parquet(f"{path}/manifest")
    _root(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/root")
    return path


def _joined(*fields: str) -> Column:
    """sha256 over the last field of a group's rows, in the order of the others."""
    rows = F.array_sort(F.collect_list(F.struct(*fields)))
    return F.sha2(F.concat_ws("", F.transform(rows, lambda x: x[fields[-1]])).cast("binary"), 256)


def _manifest(recipes: DataFrame, each: int = 1000) -> DataFrame:
    """tokens, documents and part_root of each part; no row gathers more than `each` documents, or their thousandth part."""
    own = F.sha2(F.concat_ws(":", "place", "start_in_part", "doc_id", F.hex("doc_root")).cast("binary"), 256)
    nodes = recipes.select("part", F.floor(F.col("place") / each).alias("node"), "place", "n_tokens", own.alias("own"))
    nodes = nodes.groupBy("part", "node").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), _joined("place", "own").alias("node_root"))
    return nodes.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"), _joined("node", "node_root").alias("part_root"))


def _root(manifest: DataFrame) -> DataFrame:
    """One row over the parts, of which there are few."""
    return manifest.agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), _joined("part", "part_root").alias("root"))


def _crc_tables(levels: int = 40) -> np.ndarray:
    """tables[k, b, v]: byte v at place b of a CRC-32 after 2**k further zero bytes."""
    poly = 0xEDB88320
    one = np.zeros(32, np.uint32)
    for i in range(32):  # the image of bit i after one zero byte
        v = 1 << i
        for _ in range(8):
            v = (v >> 1) ^ (poly if v & 1 else 0)
        one[i] = v

    def spread(bits: np.ndarray) -> np.ndarray:
        t = np.zeros((4, 256), np.uint32)
        for b in range(4):
            for i in range(8):
                t[b, (np.arange(256) >> i) & 1 == 1] ^= bits[8 * b + i]
        return t

    def apply(t: np.ndarray, v: np.ndarray) -> np.ndarray:
        return t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]

    out, bits = [], one
    for _ in range(levels):
        t = spread(bits)
        out.append(t)
        bits = apply(t, bits)
    return np.stack(out)


def crc_shift(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 parts moved over `zeros` following bytes, so that their xor is the CRC-32 of the joined bytes."""
    v = crc.astype(np.uint32)
    for k in range(len(tables)):
        on = (zeros >> k) & 1 == 1
        if on.any():
            w, t = v[on], tables[k]
            v[on] = t[0][w & 255] ^ t[1][(w >> 8) & 255] ^ t[2][(w >> 16) & 255] ^ t[3][w >> 24]
    return v


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, n, ids): every stored chunk, its bytes checked against its address."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            bodies = [_wide(press.decompress(p), n) for p, n in zip(batch.column("payload").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            for name, body in zip(batch.column("chunk_id").to_pylist(), bodies, strict=True):
                if hashlib.sha256(body).digest() != name:
                    raise ValueError(f"chunk {name.hex()} does not match its address")
            yield pa.record_batch([batch.column("chunk_id").cast(pa.binary()), batch.column("n").cast(pa.int32()), pa.array(bodies, pa.binary())], names=["chunk_id", "n", "ids"])

    return spark.read.parquet(f"{path}/chunks").mapInArrow(load, "chunk_id binary, n int, ids binary")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with `start`, the ids of all documents before; every part is held against the manifest, the manifest against the root."""
    from pyspark.sql import Window

    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    if _root(manifest).exceptAll(spark.read.parquet(f"{path}/root")).count():
        raise ValueError("the manifest does not match the root")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part file
    parts = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    found = _manifest(recipes).select("part", *[F.col(k).alias(f"found_{k}") for k in ("tokens", "documents", "part_root")])
    same = (F.col("tokens") == F.col("found_tokens")) & (F.col("documents") == F.col("found_documents")) & (F.col("part_root") == F.col("found_part_root"))
    parts = parts.join(found, "part", "full").select("part", F.when(same, F.col("base")).otherwise(F.raise_error(F.lit("a part does not match the manifest")).cast("long")).alias("base"))
    return parts.join(recipes, "part", "left").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "chunk_ids", "chunk_lengths", "doc_root")


def _with_chunks(uses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each use with its chunk; one that is not there fails the read."""
    here = F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("int"))
    return uses.join(chunks, "chunk_id", "left").withColumn("n", here)


def _uses(recipes: DataFrame) -> DataFrame:
    """One row per use of a chunk: doc_id, start, n_tokens, place, chunk_id, after (ids of the document behind it)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, start, n, names, lengths, root in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "start", "n_tokens", "chunk_ids", "chunk_lengths", "doc_root")], strict=True):
                if hashlib.sha256(b"".join(names)).digest() != root or sum(lengths) != n:
                    raise ValueError("a recipe does not match its root")
                after = n
                for place, (name, length) in enumerate(zip(names, lengths, strict=True)):
                    after -= length
                    rows.append((doc_id, start, n, place, name, after))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _USE, strict=True)] if rows else [pa.array([], f.type) for f in _USE], schema=_USE)

    return recipes.mapInArrow(spread, "doc_id long, start long, n_tokens long, place int, chunk_id binary, after long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document put together from its verified chunks."""
    uses = _with_chunks(_uses(_recipes(spark, path)), read_chunks(spark, path))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: F.hex(x["ids"]))
    whole = uses.groupBy("doc_id", "start", "n_tokens").agg(F.unhex(F.concat_ws("", parts)).alias("ids"), F.sum("n").alias("found"))
    complete = F.when(F.col("found") == F.col("n_tokens"), F.col("ids")).otherwise(F.raise_error(F.lit("lengths do not add up")).cast("binary"))
    return whole.select("doc_id", "start", "n_tokens", complete.alias("ids"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored chunks.

    Each stored chunk is read, verified and summed once; a document's CRC-32 is composed from those of its
    chunks, so no ids are moved between tasks.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("chunk_id").cast(pa.binary()), batch.column("n").cast(pa.int32()), pa.array([zlib.crc32(b) for b in batch.column("ids").to_pylist()], pa.int64())], schema=_SUM)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _crc_tables()
        for batch in batches:
            moved = crc_shift(batch.column("crc").to_numpy(zero_copy_only=False), 4 * batch.column("after").to_numpy(zero_copy_only=False).astype(np.int64), tables)
            yield pa.record_batch([batch.column(k) for k in ("doc_id", "start", "n_tokens", "n")] + [pa.array(moved.astype(np.int64))], names=["doc_id", "start", "n_tokens", "n", "crc"])

    uses = _with_chunks(_uses(_recipes(spark, path)), read_chunks(spark, path).mapInArrow(sums, "chunk_id binary, n int, crc long"))
    moved = uses.select("doc_id", "start", "n_tokens", "n", "crc", "after").mapInArrow(shift, "doc_id long, start long, n_tokens long, n int, crc long")
    whole = moved.groupBy("doc_id", "start", "n_tokens").agg(F.sum("n").alias("found"), F.expr("bit_xor(crc)").alias("ids_crc32"))
    complete = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("lengths do not add up")).cast("long"))
    return whole.select("doc_id", "start", "n_tokens", complete.alias("ids_crc32"))
