"""Sources, sinks, converters, summaries, prompts, plugins, alignment and streaming on small files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import prompts
from quirefold.operators import align, converters, evaluate, fewshot, plugins, summary
from quirefold.plans import registry, runs
from quirefold.sources import corpus, sinks
from quirefold.streaming import incremental


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "set"
    for kind, files in {"gt": {"0001": "a b\r\nc", "0002": "d\n"}, "transcription": {"0001": "a b c", "0002": "d"}, "ocr": {"0001": "a x\nc"}}.items():
        (root / kind).mkdir(parents=True)
        for k, t in files.items():
            (root / kind / f"{k}.txt").write_bytes(t.encode())
    for p in ("0001/page/2.jpg", "0001/1.png", "0001/deep/er/3.png", "0002/x.TXT", "0003/img/1.tif"):
        f = root / "images" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    return root


def test_corpus(spark, folder):
    rows = {r["id"]: r for r in corpus.corpus(spark, str(folder), "s").collect()}
    assert rows["0001"]["gt"] == "a b\nc" and rows["0002"]["gt"] == "d\n" and rows["0002"]["ocr"] is None
    assert [r["id"] for r in corpus.sample_ids(spark, str(folder)).collect()] == ["0001", "0002"]
    assert [r["id"] for r in corpus.sample_ids(spark, str(folder), ["0002", "9"]).collect()] == ["0002"]
    assert corpus.sample_ids(spark, str(folder / "none")).count() == 0
    assert corpus.text_files(spark, str(folder / "gt"), stripped=True).where("id = '0002'").first()["text"] == "d"
    short = lambda r: [p.rsplit("/images/", 1)[1] for p in r["images"]]
    assert {r["id"]: short(r) for r in corpus.page_images(spark, str(folder / "images")).collect()} == {"0001": ["0001/1.png", "0001/page/2.jpg"]}
    assert {r["id"]: short(r) for r in corpus.legacy_page_images(spark, str(folder / "images")).collect()} == {"0001": ["0001/1.png", "0001/page/2.jpg"], "0003": ["0003/img/1.tif"]}
    (folder / "ids").write_text("0001\n\n 0002 \n")
    assert corpus.id_list(spark, str(folder / "ids")) == ["0001", "0002"] == corpus.id_list(spark, "0001, 0002,")
    assert corpus.registry(spark).count() == 6


def test_results_and_summary(spark, tmp_path):
    rows = spark.createDataFrame([("0002", 3, 4, *[0.5] * 14), ("0001", 1, 2, *[1.0] * 14)], "id string, len_gt int, len_pred int, " + ", ".join(f"{m} double" for m in evaluate.METRICS))
    sinks.write_evaluation_csv(rows, str(tmp_path / "one"))
    text = next((tmp_path / "one").glob("part*")).read_text().splitlines()
    assert text[0].startswith("id,len_gt") and text[1].startswith("0001,1,2,1.0") and text[3] == "" and text[4].startswith("macro_avg,,,0.75")
    out = tmp_path / "results"
    out.mkdir()
    (out / "iam_print_eval_m1.csv").write_text("\n".join(text) + "\n")
    (out / "evaluation_m2_iam_print.csv").write_text("\n".join(text) + "\n")
    long = summary.summary_long(corpus.result_files(spark, str(out)))
    got = {r["method"]: r for r in long.collect()}
    assert set(got) == {"m1", "m2"} and got["m1"]["dataset"] == "iam_print" and got["m1"]["n_samples"] == 2 and got["m1"]["wer"] == 0.75 and got["m1"]["len_gt"] is None
    wide = summary.summary_wide(long)
    assert wide.count() == 1 and "m1_wer" in wide.columns and "m1_len_gt" not in wide.columns
    (out / "broken_eval_m3.csv").write_text("\n".join(text[:3]) + "\n")
    with pytest.raises(Exception, match="no macro_avg"):
        summary.summary_long(corpus.result_files(spark, str(out))).collect()
    sinks.write_text_per_id(spark.createDataFrame([("a", "x\ny")], "id string, text string"), str(tmp_path / "texts"))
    assert (tmp_path / "texts" / "a.txt").read_text() == "x\ny"


def test_forms_and_attributes(spark, tmp_path):
    form = """<?xml version="1.0" encoding="ISO-8859-1"?><!DOCTYPE form SYSTEM "f.dtd">
    <form id="a01" width="2000"><machine-printed-part><machine-print-line text="One é"/></machine-printed-part>
    <handwritten-part><line id="l1" text=" One "><word text="One"><cmp x="5" y="400" width="10" height="20"/><cmp x="40" y="390" width="10" height="20"/></word></line><line id="l2" text=""/></handwritten-part></form>"""
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a01.xml").write_bytes(form.encode("latin-1"))
    hand, printed = converters.convert_forms(corpus.forms(spark, str(tmp_path / "x")))
    assert hand.first()["gt"] == "One" and tuple(hand.first()["box"]) == (0, 380, 60, 430)
    assert printed.first()["gt"] == "One é" and tuple(printed.first()["box"]) == (0, 300, 2000, 360)
    ns = 'xmlns="http://example.org/2010-03-19"'
    words = '<AttrRegion attrType="1" fontType="2" text="world"><minAreaRect><Point x="9"/><Point x="7.5"/></minAreaRect></AttrRegion><AttrRegion attrType="1" fontType="2" text="hello"/><AttrRegion attrType="1" fontType="1" text="no"/>'
    page = f'<?xml version="1.0" encoding="utf-16"?><Root {ns}><Page><AttrRegion attrType="2" fontType="2" id="0052-6-1">{words}</AttrRegion><AttrRegion attrType="2" fontType="2" id="0052-7-1">{words}</AttrRegion></Page></Root>'
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "0052-6_attributes.xml").write_bytes(page.encode("utf-16"))
    (tmp_path / "p" / "0053-6_attributes.xml").write_bytes(page.replace("0052", "0053").replace("world", "wörld").replace("utf-16", "latin-1").encode("latin-1"))
    got = {(r["writer"], r["line_id"]): r["text"] for r in converters.attribute_lines(corpus.attribute_xml(spark, str(tmp_path / "p"), "6"), "6").collect()}
    assert got == {("0052", "0052-6-1"): "hello world", ("0053", "0053-6-1"): "hello wörld"}


def test_cells_manifest_and_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Category,_0,_1,_2,_10\n1A,x,a,," c ",late\n1B,x,,,,\n')
    (tmp_path / "b.csv").write_text("ID,Category,_0\n2A,x,only\n")
    got = {r["id"]: r["gt"] for r in converters.convert_cells(corpus.cell_tables(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])).collect()}
    assert got == {"1A": "a\nlate\nc", "2A": "only"}
    (tmp_path / "m.tsv").write_text("p/1.tif\tsome text\there\nbroken\np/2.tif\t\n")
    assert [tuple(r) for r in corpus.line_manifest(spark, str(tmp_path / "m.tsv")).collect()] == [("p/1.tif", "some text\there")]
    lines = spark.createDataFrame([(str(w), f"p/{w}.tif", "two words") for w in range(50)], "writer string, image_path string, text string")
    stats = {r["part"]: r for r in converters.manifest_stats(converters.manifest(lines, 2)).collect()}
    assert stats["train"]["count"] + stats["val"]["count"] == 50 and stats["train"]["avg_words"] == 2
    none = {r["part"]: r["count"] for r in converters.manifest_stats(converters.manifest(lines, 3)).collect()}
    assert none == {"train": 0, "val": 0}
    assert json.loads(sinks.stats_json(converters.manifest_stats(converters.manifest(lines)), "6", ["a"]).first()[0])["writers_total"] == 50
    files = spark.createDataFrame([("d/p12_3.JPG",), ("d/x.png",), ("d/4.txt",)], "path string")
    assert [(r["id"], r["destination"]) for r in converters.page_folders(files).collect()] == [("123", "images/123/p12_3.JPG")]


def test_examples_and_prompts(spark):
    ids = [f"d{k}" for k in range(8)]
    df = spark.createDataFrame([(i, f"g {i}", f"t {i}", f"o {i}", [f"{i}.png"]) for i in ids], "id string, gt string, transcription string, ocr string, images array<string>")
    drawn = fewshot.seeded_examples(df, ids, 2, 42)
    got = {}
    for r in drawn.collect():
        got.setdefault(r["id"], {})[r["position"]] = r["sample_id"]
    for i in ids:
        assert [got[i][k] for k in sorted(got[i])] == random.Random(42).sample([x for x in ids if x != i], 2)
    hashed = fewshot.hashed_examples(df, 3, 1)
    assert hashed.count() == 24 and hashed.where("id = sample_id").count() == 0
    with_examples = df.join(fewshot.load_examples(drawn, df, "m3"), "id")
    r = with_examples.select("examples", prompts.render("m3", F.lit("{htr} x"), F.lit("y"), F.col("examples")).alias("p")).first()
    assert r["p"].count("Example 2:\n") == 1 and r["p"].endswith("Correct transcription:\n{htr} x\n\nHTR/OCR output with line breaks:\ny") and prompts.EXAMPLE_FOOT in r["p"]
    assert "examples:" not in spark.range(1).select(prompts.render("m1", F.lit("t"))).first()[0]


def test_alignment(spark):
    df = spark.createDataFrame([("1", "one two three four", "ome twoo\nthrea fuor", ["a.png", "b.png"]), ("2", " ", "x", ["a.png"])], "id string, transcription string, ocr string, images array<string>")
    s = plugins.ModelSettings("echo/x")
    one = {r["id"]: (r["prediction"], r["error"]) for r in align.align("m1", df, s, backend="echo").collect()}
    assert one["1"][0].endswith("three four") and one["2"] == ("", None)
    three = {r["id"]: r["prediction"] for r in align.align("m3", df, s, backend="echo").collect()}
    assert three["2"] == "" and three["1"].endswith("threa fuor")


def test_failures_retries_and_throttle(spark):
    def wrong(settings):
        class Backend:
            def generate(self, prompt, images=None):
                if "bad" in prompt:
                    raise ValueError("no")
                return prompt.upper()

        return Backend()

    df = spark.createDataFrame([("a",), ("bad",)], "prompt string")
    got = {r["prompt"]: (r["value"], r["error"]) for r in plugins.generate(df, plugins.ModelSettings("x"), factory=wrong).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no")}
    with pytest.raises(ValueError, match="unknown plugin"):
        plugins.make(plugins.BACKENDS, "nothing")
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise plugins.Transient("503")
        return "ok"

    assert plugins.with_retries(flaky, sleep=slept.append) == "ok" and slept == [3.0, 6.0]

    def spent():
        raise RuntimeError("429 RequestsPerDay per_day limit")

    with pytest.raises(plugins.QuotaExhausted):
        plugins.with_retries(spent, sleep=slept.append)
    now = [0.0]
    t = plugins.Throttle(25, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        t.wait()
    assert now[0] == pytest.approx(4.8)
    assert plugins.ModelSettings("Gemini/x").provider == "gemini" and plugins.ModelSettings("a/b").name == "a/b"


def test_incremental(spark, tmp_path):
    key = {"method": "m3", "dataset": "d", "model": "x", "n_shots": 0}
    docs = str(tmp_path / "docs")
    predict = lambda df: df.select("id", F.when(F.col("id") != "c", F.col("gt")).alias("prediction"), F.when(F.col("id") == "c", "failed").alias("error"))
    run = lambda: incremental.evaluate_new(spark, docs, "id string, gt string", predict, str(tmp_path / "r"), str(tmp_path / "cp"), key)
    spark.createDataFrame([("a", "x"), ("c", "y")], "id string, gt string").write.parquet(docs)
    assert run() >= 1
    spark.createDataFrame([("a", "x"), ("b", "z")], "id string, gt string").write.mode("append").parquet(docs)
    run()
    done = incremental.results(spark, str(tmp_path / "r"))
    assert sorted(r["id"] for r in done.collect()) == ["a", "b"]
    whole = lambda df: df.select("id", F.col("gt").alias("prediction"), F.lit(None).cast("string").alias("error"))
    incremental.evaluate_new(spark, docs, "id string, gt string", whole, str(tmp_path / "r"), str(tmp_path / "cp"), key)
    assert sorted(r["id"] for r in incremental.results(spark, str(tmp_path / "r")).collect()) == ["a", "b", "c"]  # the failed one came again
    done = incremental.results(spark, str(tmp_path / "r")).where("id <> 'c'")
    for _ in range(2):  # a run without failures, and one after it
        incremental.evaluate_new(spark, docs, "id string, gt string", whole, str(tmp_path / "r2"), str(tmp_path / "cp2"), key)
    assert incremental.results(spark, str(tmp_path / "r2")).count() == 3 and not list((tmp_path / "cp2_predictions").glob("*"))
    state = sinks.checkpoint_state(done).first()
    assert state["processed_ids"] == ["a", "b"] and state["sums"]["wer"] == 0.0


def test_quota_keeps_finished_rows(spark, tmp_path):
    """A quota that ends after two calls: those rows are committed, the rest comes with the next run."""

    def backend(settings):
        class Backend:
            def __init__(self):
                self.left = 2

            def generate(self, prompt, images=None):
                self.left -= 1
                if self.left < 0:
                    raise plugins.QuotaExhausted("429 per_day")
                return prompt

        return Backend()

    docs = str(tmp_path / "docs")
    spark.createDataFrame([(x, x) for x in "abcd"], "id string, gt string").coalesce(1).write.parquet(docs)
    predict = lambda df: plugins.generate(df.coalesce(1).withColumn("prompt", F.col("gt")), plugins.ModelSettings("x"), factory=backend).select("id", F.col("value").alias("prediction"), "error")
    key = {"method": "m3", "dataset": "d", "model": "x", "n_shots": 0}
    run = lambda: incremental.evaluate_new(spark, docs, "id string, gt string", predict, str(tmp_path / "r"), str(tmp_path / "cp"), key)
    with pytest.raises(plugins.QuotaExhausted):
        run()
    assert incremental.results(spark, str(tmp_path / "r")).count() == 2
    run()
    assert sorted(r["id"] for r in incremental.results(spark, str(tmp_path / "r")).collect()) == list("abcd")


def test_each_page_is_asked_once(spark, tmp_path):
    """Model calls leave a mark in a file: a page with text gives one, a document without text none."""
    log = str(tmp_path / "calls")

    class Logged:
        def __init__(self, settings=None):
            pass

        def generate(self, prompt, images=None):
            with open(log, "a") as f:
                f.write("x\n")
            return "\n".join(images)

    df = spark.createDataFrame([("1", "one two three four", ["a.png", "b.png"]), ("2", " ", ["a.png"]), ("3", "five", [])], "id string, transcription string, images array<string>")
    got = {r["id"]: r["prediction"] for r in align.align("m1", df, plugins.ModelSettings("x"), factory=Logged).collect()}
    assert got == {"1": "a.png\nb.png", "2": "", "3": ""} and open(log).read() == "x\n" * 2
    pages = {r["id"]: r["prediction"] for r in plugins.transcribe_pages(df, plugins.ModelSettings("x"), factory=Logged).collect()}
    assert pages == {"1": "a.png\nb.png", "2": "a.png", "3": ""}


def test_recognition_cuts_merges_and_assembles(spark, tmp_path):
    class Boxes:
        """Two words of one line and a line below, found out of order."""

        def segment_page(self, image):
            if "blank" in image:
                return []
            found = [(10, 100, 60, 120), (60, 12, 100, 30), (10, 10, 50, 30)]
            return [{"path": image, "x1": a, "y1": b, "x2": c, "y2": d, "height": 200, "confidence": None} for a, b, c, d in found]

    def cutter():
        def cut(image, jobs):
            for box, path in jobs:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w") as f:
                    f.write(f"{box[0]},{box[1]},{box[2]},{box[3]}")

        return cut

    class Reader:
        def recognize_lines(self, paths):
            return [open(p).read() if os.path.exists(p) else p for p in paths]

    plugins.SEGMENTERS["boxes"], plugins.CUTTERS["files"], plugins.RECOGNIZERS["reader"] = Boxes, cutter, Reader
    pages = spark.createDataFrame([("d", 0, "/in/p1.png"), ("d", 1, "/in/blank.png"), ("d", 2, "/in/p2.png"), ("e", 0, "/in/p3.png")], "id string, page int, image string")
    read = lambda **k: {r["id"]: (r["ocr"], r["num_pages"], r["num_lines"]) for r in plugins.recognize_documents(pages, "boxes", "reader", cache_root=str(tmp_path), cutter="files", **k).collect()}
    one = "8,8,102,32\n8,98,62,122"
    assert read(merge="same_line", padding=2) == {"d": (f"{one}\n\n{one}", 3, 4), "e": (one, 1, 2)}
    assert (tmp_path / "d" / "p1" / "p1_line001.png").exists()
    assert read(merge=None)["e"] == ("10,10,50,30\n60,12,100,30\n10,100,60,120", 1, 3)
    done = spark.createDataFrame([("d",)], "id string")
    assert set(read(merge="same_line", done=done)) == {"e"} and read(merge="same_line", max_pages=1)["d"][1] == 1
    assert {r["id"]: r["num_pages"] for r in plugins.dry_run(pages, done=done).collect()} == {"e": 1}
    crops = spark.createDataFrame([("p1", ["x", "y"])], "page string, crops array<string>")
    got = {r["id"]: r["ocr"] for r in plugins.recognize_documents(pages, "passthrough", "reader", crops=crops).collect()}
    assert got == {"d": "x\ny\n\n/in/blank.png\n\n/in/p2.png", "e": "/in/p3.png"}
    docs = plugins.recognize_documents(pages, "passthrough", "reader")
    assert sinks.write_ocr(docs, str(tmp_path / "out"), "set", "passthrough", "reader", None, "cache") == 2
    assert (tmp_path / "out/ocr/e.txt").read_text() == "/in/p3.png"
    assert json.loads((tmp_path / "out/ocr/e.meta.json").read_text())["num_pages"] == 1
    assert plugins.RECOGNIZERS["trocr_printed"].model_id != plugins.RECOGNIZERS["trocr_handwritten"].model_id


def test_folder_names_are_taken_as_they_are(spark, tmp_path):
    root = tmp_path / "a+b(1" / "x" / "a+b(1"
    for name in ("d1/p1.png", "d1/page/p2.png", "d1/deep/er/p3.png", "d2/images/q.jpg", "d2/other/r.jpg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    got = {r["id"]: [p.rsplit("/", 1)[-1] for p in r["images"]] for r in corpus.page_images(spark, str(root)).collect()}
    assert got == {"d1": ["p1.png", "p2.png"]}
    old = {r["id"]: [p.rsplit("/", 1)[-1] for p in r["images"]] for r in corpus.legacy_page_images(spark, str(root)).collect()}
    assert old == {"d1": ["p1.png", "p2.png"], "d2": ["q.jpg"]}


def test_runs_and_registry(spark):
    assert runs.run_matrix(spark, "hf/x").count() == 54
    assert set(registry.oracle_sql()) <= set(registry.queries())
