"""Encoding, packing and the id store: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import packing, store
from quirefold.llm.tokens import Encoder

CUTS = {"byte_bpe_50k.json": "before_space", "word_bpe_49k.json": "white_space"}
PIECES = list("abAB12.,'~_ \n\té̈ΣİßÄ\x1c\x85\u00a0日") + [" ", " word", " Don't", "\nThat", "x.", "<|endoftext|>", "<|startoftext|>", "  "]
TEXT = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


@pytest.mark.parametrize("name", CUTS)
@pytest.mark.parametrize("special", [True, False])
def test_words_encode_like_whole_texts(name, special, vocabularies):
    from tokenizers import Tokenizer

    coder, plain = Encoder(vocabularies[name], CUTS[name], special), Tokenizer.from_file(vocabularies[name])
    plain.encode_special_tokens = not special

    @settings(max_examples=300, deadline=None)
    @given(st.lists(TEXT, max_size=6))
    def check(texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    check()
    many = [f"word{k % 7}. Und" + "ab" * (k % 90) + " é" for k in range(400)]
    assert coder.encode([*many, None]) == [*coder._whole(many), b""]


def test_special_strings_as_the_library_encodes_them(vocabularies):
    coder = Encoder(vocabularies["byte_bpe_50k.json"], "before_space")
    assert np.frombuffer(coder.encode(["hello <|endoftext|> world"])[0], "<u4").tolist() == [31373, 220, 50256, 995]


def expected(all_rows, path, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x, *_ in all_rows]


def test_packing_places_each_id_once(docs, empty, all_rows, vocabularies):
    path = vocabularies["byte_bpe_50k.json"]
    got = packing.pack(docs.repartition(3), path, group_tokens=5000).collect()
    want = sorted((i if i is not None else -1, s.tobytes()) for i, s in expected(all_rows, path, 1))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["start"] + r["length"] <= r["doc_tokens"] and len(r["ids"]) == 4 * r["length"]
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    unique = {}
    for r in got:
        unique.setdefault((r["doc_id"], r["start"], r["length"]), []).append(bytes(r["ids"]))
    total = sum(r["length"] for r in got)
    assert total == sum(len(s) // 4 for _, s in want)
    whole = {}
    for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        if r["doc_id"] is not None and r["doc_id"] != 9:
            whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    assert all(whole[i] == s for i, s in want if i not in (-1, 9))
    assert len(by_sequence) * 2048 - total <= 2048 * 8
    assert packing.pack(empty, path).count() == 0


def test_assign_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 300).tolist() + [5000]
    pieces, count = packing.assign(lengths, 1024)
    assert count == -(-sum(lengths) // 1024) and sum(n for _, _, n, _, _ in pieces) == sum(lengths)
    covered = {}
    for k, at, n, _, _ in sorted(pieces):
        assert covered.get(k, 0) == at
        covered[k] = at + n
    assert covered == {k: n for k, n in enumerate(lengths)}


def test_store_round_trip(spark, docs, empty, all_rows, vocabularies, tmp_path):
    path = vocabularies["word_bpe_49k.json"]
    folder = store.write_store(docs, path, path=str(tmp_path / "s"), shortest=8, mask=15, longest=64)
    want = sorted(((i if i is not None else -1, len(s), zlib.crc32(s.tobytes()), s.tobytes()) for i, s in expected(all_rows, path, 2)))
    sums = store.read_checksums(spark, folder).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in sums)
    assert got == [w[:3] for w in want]
    at = 0
    for r in sorted(sums, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(sums, key=lambda r: r["start"])]
    assert ids == sorted(ids)
    whole = sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["ids"])) for r in store.read_documents(spark, folder).collect())
    assert whole == [(w[0], w[3]) for w in sorted(want, key=lambda w: (w[0], w[3]))]
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    assert chunks.agg(F.sum("n")).first()[0] < sum(w[1] for w in want)  # copies are stored once
    nothing = store.write_store(empty, path, path=str(tmp_path / "e"))
    assert store.read_checksums(spark, nothing).count() == 0


def test_store_detects_damage(spark, docs, vocabularies, tmp_path):
    folder = store.write_store(docs.limit(4), vocabularies["word_bpe_49k.json"], path=str(tmp_path / "d"))
    bad = spark.read.parquet(f"{folder}/chunks").withColumn("chunk_id", F.reverse(F.col("chunk_id").cast("string")).cast("binary")).cache()
    bad.count()
    bad.write.mode("overwrite").parquet(str(tmp_path / "d2" / "chunks"))
    with pytest.raises(Exception, match="address"):
        store.read_chunks(spark, str(tmp_path / "d2")).count()


def test_edit_moves_only_near_cuts():
    ids = np.random.default_rng(3).integers(0, 49000, 20000).astype("<u4")
    gear = store._gear()

    def cut(x):
        ends = store.cut_points(x, gear, 64, 255, 2048)
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}

    edited = np.concatenate([ids[:5000], np.array([7], "<u4"), ids[5000:]])
    assert len(cut(ids) - cut(edited)) <= 3


def test_store_misses_nothing(spark, docs, vocabularies, tmp_path):
    """A document without any chunk left, and a recipe that is gone."""
    folder = store.write_store(docs.limit(4), vocabularies["word_bpe_49k.json"], path=str(tmp_path / "m"))
    recipes, chunks = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/chunks")
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert store.read_checksums(spark, folder).count() == 4
    one = recipes.select("doc_id", F.explode("chunk_ids").alias("chunk_id")).where("doc_id = 1").select("chunk_id")
    fewer = manifest.withColumn("documents", F.col("documents") + 1)
    shorter = recipes.withColumn("chunk_lengths", F.transform("chunk_lengths", lambda n: n - 1))
    altered = recipes.withColumn("doc_root", F.sha2("doc_root", 256).cast("binary"))
    cases = [
        ("chunk", "a chunk is missing", recipes, chunks.join(one, "chunk_id", "left_anti"), manifest),
        ("recipe", "a part does not match", recipes.where("doc_id <> 1"), chunks, manifest),
        ("altered", "a part does not match", altered, chunks, manifest),
        ("lengths", "a recipe does not match", shorter, chunks, manifest),
        ("manifest", "the manifest does not match", recipes, chunks, fewer),
        ("part", "the manifest does not match", recipes, chunks, manifest.limit(0)),
    ]
    for name, says, r, c, m in cases:
        bad = str(tmp_path / name)
        for table, rows in (("recipes", r), ("chunks", c), ("manifest", m), ("root", spark.read.parquet(f"{folder}/root"))):
            rows.write.parquet(f"{bad}/{table}")
        for read in (store.read_documents, store.read_checksums):
            with pytest.raises(Exception, match=says):
                read(spark, bad).collect()


def test_cuts_of_many_streams_are_those_of_each():
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, 300, n).astype("<u4").tobytes() for n in (1, 15, 16, 40, 3000, 17, 0, 900)]
    gear = store._gear()
    for shortest in (8, 16, 20):
        assert store.cuts_of(streams, gear, shortest, 7, 100) == [store.cut_points(np.frombuffer(s, "<u4"), gear, shortest, 7, 100) for s in streams]


def test_chunk_files_grow_with_the_chunks(spark, docs, vocabularies, tmp_path):
    from pathlib import Path

    files = {}
    for n in (1, 500_000):
        folder = store.write_store(docs, vocabularies["word_bpe_49k.json"], path=str(tmp_path / f"w{n}"), shortest=16, mask=15, longest=64, part_chunks=n)
        files[n] = len(list(Path(folder, "chunks").glob("*.parquet")))
        chunks = spark.read.parquet(f"{folder}/chunks")
        assert chunks.count() == chunks.select("chunk_id").distinct().count()
        assert store.read_checksums(spark, folder).count() == docs.count()
    assert files[1] > 2 * files[500_000]
