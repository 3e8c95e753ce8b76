"""Versioned tables, resuming after a crash, the command line, cell files, examples of large pools, ranks and running minima."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold import __main__ as program
from quirefold.operators import converters, evaluate, fewshot, ordered, plugins
from quirefold.sources import corpus, versions
from quirefold.streaming import incremental

KEY = {"method": "m3", "dataset": "d", "model": "x", "n_shots": 0}


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def table(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_a_commit_is_one_step(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert versions.latest(spark, root) == 0 and versions.read(spark, root, "rows", "id string").count() == 0
    versions.commit(spark, root, add={"rows": table(spark, "ab")}, replace={"failed": table(spark, "c")})
    versions.commit(spark, root, add={"rows": table(spark, "d")}, replace={"failed": table(spark, "e")})
    assert ids(versions.read(spark, root, "rows")) == ["a", "b", "d"] and ids(versions.read(spark, root, "failed")) == ["e"]
    assert ids(versions.read(spark, root, "rows", version=1)) == ["a", "b"] and ids(versions.read(spark, root, "failed", version=1)) == ["c"]

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # both tables are written, the pointer is not
        m.setattr(versions, "_publish", crash)
        with pytest.raises(KeyboardInterrupt):
            versions.commit(spark, root, add={"rows": table(spark, "f")}, replace={"failed": versions.read(spark, root, "rows")})
    assert ids(versions.read(spark, root, "rows")) == ["a", "b", "d"] and ids(versions.read(spark, root, "failed")) == ["e"]
    assert len(list((tmp_path / "t" / "rows").iterdir())) == 3
    versions.compact(spark, root, "rows", 1)
    versions.vacuum(spark, root, keep=1)
    assert len(list((tmp_path / "t" / "rows").iterdir())) == 1 and ids(versions.read(spark, root, "rows")) == ["a", "b", "d"]


def test_a_second_writer_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.commit(spark, root, add={"rows": table(spark, "a")})
    with pytest.raises(RuntimeError, match="another writer"):
        versions._publish(spark, root, 1, {"rows": []})
    assert ids(versions.read(spark, root, "rows")) == ["a"]


def test_a_crash_between_results_and_failures(spark, tmp_path, monkeypatch):
    """The batch that crashed comes again: no row twice, no failure lost."""
    docs, root = str(tmp_path / "docs"), str(tmp_path / "r")
    spark.createDataFrame([(x, x) for x in "abc"], "id string, gt string").write.parquet(docs)
    predict = lambda df: df.select("id", F.when(F.col("id") != "c", F.col("gt")).alias("prediction"), F.when(F.col("id") == "c", "no").alias("error"))
    run = lambda p=predict: incremental.evaluate_new(spark, docs, "id string, gt string", p, root, str(tmp_path / "cp"), KEY)
    publish = versions._publish
    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    assert versions.latest(spark, root) == 0 and versions._publish is publish
    run()
    assert ids(incremental.results(spark, root)) == ["a", "b"] and ids(versions.read(spark, root, "failed")) == ["c"]
    run(lambda df: df.select("id", F.col("gt").alias("prediction"), F.lit(None).cast("string").alias("error")))
    assert ids(incremental.results(spark, root)) == ["a", "b", "c"] and ids(versions.read(spark, root, "failed")) == []


def test_many_parts_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MANY", 1)
    docs, root = str(tmp_path / "docs"), str(tmp_path / "r")
    whole = lambda df: df.select("id", F.col("gt").alias("prediction"), F.lit(None).cast("string").alias("error"))
    for name in "abc":
        spark.createDataFrame([(name, name)], "id string, gt string").write.mode("append").parquet(docs)
        incremental.evaluate_new(spark, docs, "id string, gt string", whole, root, str(tmp_path / "cp"), KEY)
    assert ids(incremental.results(spark, root)) == ["a", "b", "c"] and len(versions.parts(spark, root, "rows")) == 1


def test_the_program_ends_with_75_when_a_quota_is_spent(spark, tmp_path):
    calls = []

    def backend(settings):
        class Backend:
            left = 2

            def generate(self, prompt, images=None):
                Backend.left -= 1
                if Backend.left < 0:
                    raise plugins.QuotaExhausted("429 per day")
                return "x"

        return Backend()

    spark.createDataFrame([(x, x, f"{x} text", "o") for x in "abc"], "id string, gt string, transcription string, ocr string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    argv = ["--method", "m3", "--documents", str(tmp_path / "docs"), "--results", str(tmp_path / "r"), "--checkpoint", str(tmp_path / "cp"), "--dataset", "d", "--model", "echo/x"]
    codes = [program.main(argv, spark, backend) for _ in range(2)]
    assert codes == [75, 0] and ids(incremental.results(spark, str(tmp_path / "r"))) == ["a", "b", "c"] and not calls
    with pytest.raises(SystemExit):
        program.main(["--method", "m9"], spark)


def test_cell_files_are_one_scan(spark, tmp_path):
    """Files of different width and column order, quoted line breaks and commas; a thousand of them give one scan."""
    folder = tmp_path / "cells"
    folder.mkdir()
    for i in range(1000):
        names = [f"_{k}" for k in range(i % 12 + 1)]
        (folder / f"{i:04d}.csv").write_text(f"ID,Category,{','.join(names)}\n{i},c,{','.join(f'w{k}' for k in range(len(names)))}\n")
    (folder / "x.csv").write_text('Category,ID,_1,_0\nc,x,"two, and\nmore",one\nc,y,,only\n\n')
    paths = sorted(str(p) for p in folder.iterdir())
    got = corpus.cell_tables(spark, paths)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan csv") == 1
    rows = {r["ID"]: (r["Category"], r["cells"]) for r in got.collect()}
    assert len(rows) == 1002 and rows["x"] == ("c", {"_1": "two, and\nmore", "_0": "one"}) and rows["y"] == ("c", {"_0": "only"})
    assert rows["11"][1] == {f"_{k}": f"w{k}" for k in range(12)}
    text = {r["id"]: r["gt"] for r in converters.convert_cells(got.where("ID in ('x', '11')")).collect()}
    assert text["x"] == "one\ntwo, and\nmore" and text["11"].split("\n")[:4] == ["w0", "w1", "w10", "w11"]


@pytest.mark.parametrize("size,n,per_bucket", [(1, 2, 1000), (2, 3, 1000), (5, 4, 1000), (5, 9, 1000), (400, 3, 40), (400, 3, 2)])
def test_each_document_has_its_own_examples(spark, size, n, per_bucket):
    import hashlib

    names = [f"d{k}" for k in range(size)]
    got = {(r["id"], r["position"]): r["sample_id"] for r in fewshot.ring_examples(table(spark, [*names, names[0]]), n, 7, per_bucket).collect()}
    ring = sorted(names, key=lambda x: (hashlib.md5(f"7:{x}".encode()).hexdigest(), x))
    k = min(n, size - 1)
    assert got == {(x, j): ring[(i + j + 1) % size] for i, x in enumerate(ring) for j in range(k)}
    assert len({tuple(got[x, j] for j in range(k)) for x in names}) == (size if k else 1)


@pytest.mark.parametrize("size,n", [(1, 2), (3, 2), (4, 3), (60, 5)])
def test_seeded_draws_of_a_large_pool(spark, size, n):
    names = [f"d{k:02d}" for k in range(size)]
    asked = [*names, "aa", "zz"]  # two that are not in the pool
    place = lambda df: {(r["id"], r["position"]): r["sample_id"] for r in df.collect()}
    want = place(fewshot.seeded_examples(table(spark, asked), names, n, 42))
    assert place(fewshot.seeded_ranks(table(spark, asked), table(spark, names), n, 42)) == want


def test_ranks_and_running_minima(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 10**6) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(values)), "epoch int, loss int")
    got = {r["epoch"]: r["is_best"] for r in evaluate.best_so_far(rows.repartition(5), "epoch", "loss").collect()}
    assert got == {i: i == 0 or v < min(values[:i]) for i, v in enumerate(values)}
    assert ordered.at_ranks(rows, "loss", [0, 7, 250, 499, 500]) == {k: sorted(values)[k] for k in (0, 7, 250, 499)}
    assert ordered.at_ranks(rows.where("false"), "loss", [0]) == {}
