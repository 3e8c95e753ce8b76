"""Tables that change together: every commit is one step, and readers see all of a commit or nothing of it.

A root holds a folder for each part of a table and, in `_versions`, a numbered pointer file for each commit, which names the parts of
every table. A commit writes its parts first, then its pointer beside its place, and moves that there in one step. So a crash before the move leaves the
version before as it was; folders that no pointer names are removed by vacuum(). One writer at a time; the store's rename has to be atomic
(as of HDFS and local disks).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    place, fs = _fs(spark, f"{root}/_versions")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n) for n in names if n.isdigit())


def _pointer(spark: SparkSession, root: str, number: int) -> dict[str, list[str]]:
    place, fs = _fs(spark, f"{root}/_versions/{number:012d}")
    stream = fs.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last commit; 0 before the first."""
    return max(_numbers(spark, root), default=0)


def parts(spark: SparkSession, root: str, table: str, version: int | None = None) -> list[str]:
    """Folders of a table, as of a version."""
    number = latest(spark, root) if version is None else version
    return [f"{root}/{p}" for p in _pointer(spark, root, number).get(table, [])] if number else []


def read(spark: SparkSession, root: str, table: str, schema=None, version: int | None = None) -> DataFrame:
    """A table as of a version; an empty one of `schema` where nothing has been committed."""
    found = parts(spark, root, table, version)
    if not found:
        if schema is None:
            raise ValueError(f"no version of {table} in {root}")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*found)


def commit(spark: SparkSession, root: str, add: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> int:
    """Adds rows to tables and replaces tables, all in one step; returns the number of the new version.

    The tables may be made of the version before, which is only read.
    """
    number = latest(spark, root)
    state = _pointer(spark, root, number) if number else {}
    for kind, tables in (("add", add or {}), ("replace", replace or {})):
        for table, df in tables.items():
            part = f"{table}/{uuid.uuid4().hex}"
            df.write.parquet(f"{root}/{part}")
            state[table] = [*(state.get(table, []) if kind == "add" else []), part]
    _publish(spark, root, number + 1, state)
    return number + 1


def _publish(spark: SparkSession, root: str, number: int, state: dict[str, list[str]]) -> None:
    beside, fs = _fs(spark, f"{root}/_versions/.{uuid.uuid4().hex}")
    place, _ = _fs(spark, f"{root}/_versions/{number:012d}")
    out = fs.create(beside)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(beside, place):
        fs.delete(beside, False)
        raise RuntimeError(f"another writer has committed version {number} of {root}")


def compact(spark: SparkSession, root: str, table: str, files: int) -> int:
    """A version in which a table is one part of so many files."""
    return commit(spark, root, replace={table: read(spark, root, table).repartition(files)})


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes old pointers but the last `keep`, and folders that none of those names. Readers of older versions have to be done."""
    numbers = _numbers(spark, root)
    for number in numbers[:-keep]:
        place, fs = _fs(spark, f"{root}/_versions/{number:012d}")
        fs.delete(place, False)
    named = {p for n in numbers[-keep:] for found in _pointer(spark, root, n).values() for p in found}
    place, fs = _fs(spark, root)
    for table in fs.listStatus(place):
        if table.getPath().getName().startswith("_"):
            continue
        for part in fs.listStatus(table.getPath()):
            if f"{table.getPath().getName()}/{part.getPath().getName()}" not in named:
                fs.delete(part.getPath(), True)
