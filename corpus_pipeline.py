"""A training corpus from documents in five stages: language, near copies, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Rows are told apart
by 128 bits of hashes of all their columns, so null and repeated doc_ids are handled like any other; equal rows are copies of each other.
A stage deletes the tables that it has written in the shared folder as soon as it returns, but for those that its result reads, which
are small. So results of several stages can be held at once. run() deletes what is left, and each stage's output when the next is written.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import jaccard_join, langid, mixing, packing, pii
from quirefold.llm.common import WORD, bucket_of, drop_tables, made_in, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tables left by the stages of a run; none outside run().
_RUN: ContextVar[list[str] | None] = ContextVar("_RUN", default=None)


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made: list[str] = []
        with made_in(made):
            out = f(spark, docs, sf_dir)
        drop_tables(spark, made, out)
        if (left := _RUN.get()) is not None:
            left += made
        return out

    return call


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `_row`, two hashes of the whole row."""
    return docs.select(*COLUMNS).withColumn("_row", F.concat(F.hex(F.xxhash64(*COLUMNS)), F.lit("."), F.hex(F.xxhash64(F.lit(1), *COLUMNS))))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told; the others get the language that their text has, whatever their label said."""
    model = langid.fit(docs.where(bucket_of(F.col("doc_id"), 3) != 1))
    judged = langid.predict(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    return judged.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of documents alike to 0.8 or more in five-word shingles the one with the smallest doc_id."""
    rows = _keyed(docs)
    found = jaccard_join.join_components(rows.select(F.col("_row").alias("doc_id"), "text"), percent=80, width=5)
    found = materialize(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component")).distinct(), "pipeline-components")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"]
    stay = rows.select("_row", "doc_id").distinct().join(found, "_row").groupBy("_component").agg(least.alias("_row")).select("_row")
    return rows.join(stay, "_row", "left_semi").dropDuplicates(["_row", *COLUMNS]).select(*COLUMNS)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and removes terms that give it away."""
    found = pii.find(docs.select(*COLUMNS)).withColumn("text", pii.clean(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with as many copies of its words as the mix takes: whole copies, then the words of further blocks.

    Copies are parts of one text, divided by an empty line; documents of which nothing is taken go.
    """
    rows = _keyed(docs)
    plan = mixing.mix(rows.select(F.col("_row").alias("doc_id"), "text", "source"))
    plan = plan.dropDuplicates(["doc_id"]).where("taken > 0").select(F.col("doc_id").alias("_row"), "size", "first_word", "shard_size", "copies", "extra", "offset", "multiplier", "block_words", "taken")
    both = rows.join(plan, "_row")
    whole = F.col("copies").cast("int")
    extra = F.col("taken") - whole * F.col("size")
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    picked = F.array_join(F.filter(words, lambda w, i: mixing.copies_of_word(i) > whole), "")
    more = F.when(extra == 0, F.array().cast("array<string>")).when(extra == F.col("size"), F.array("text")).otherwise(F.array(picked))
    text = F.array_join(F.concat(F.array_repeat("text", whole), more), "\n\n")
    return both.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cut="before_space", end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("packing", packed)]

#: Suffix automata, token ids and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left: list[str] = []
    before = _RUN.set(left)
    try:
        for name, stage in STAGES[:-1]:
            done = stage(spark, docs, sf_dir)
            with made_in(left):
                docs = materialize(done, f"pipeline-{name}")
            drop_tables(spark, left, docs)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _RUN.reset(before)
