"""Shared pieces: the cluster's shared folder, written intermediate tables, common columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In local mode (tests) one is made where it is unset; a cluster has to name it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quirefold-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Where the tables written just now are noted; none outside made_in().
_NOTED: ContextVar[list[str] | None] = ContextVar("_NOTED", default=None)


@contextmanager
def made_in(tables: list[str]) -> Iterator[None]:
    """Notes the tables that materialize() writes in the block, for drop_tables()."""
    before = _NOTED.set(tables)
    try:
        yield
    finally:
        _NOTED.reset(before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, tables: list[str], but_for: DataFrame | None = None) -> None:
    """Deletes noted tables, but for those that a DataFrame reads."""
    read = but_for.inputFiles() if but_for is not None else []
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(tables):
        if not any(path.rsplit("/", 1)[-1] in f for f in read):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)
            tables.remove(path)


def small_batches(spark: SparkSession, size: int = 4 << 20, rows: int = 512) -> None:
    """Lowers the session's Arrow batches to `size` bytes and the vectors of its Parquet reader to `rows` rows: 10,000 long texts at once, or
    the 4,096 of a vector, are tens of megabytes in one piece for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > size or now <= 0:
        spark.conf.set(key, str(size))
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > rows:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def release_memory() -> None:
    """Gives a Python worker's freed memory back to its machine: a worker lives on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def word_count(text: Column) -> Column:
    """Number of WORD runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: Column) -> Column:
    """The WORD runs of text in order; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
