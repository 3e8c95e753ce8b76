"""Images from a folder to models as bytes: decoding, shrinking, PNG, crops, segmentation by a table function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.functions import images
from quirefold.operators import align, plugins
from quirefold.sources import corpus


def draw(spark, path, kind, width, height, dark=()):
    """A white image with black boxes, written by Java's image library."""
    path.parent.mkdir(parents=True, exist_ok=True)
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    pen = image.createGraphics()
    pen.setColor(jvm.java.awt.Color(255, 255, 255))
    pen.fillRect(0, 0, width, height)
    pen.setColor(jvm.java.awt.Color(200, 10, 0))
    for x1, y1, x2, y2 in dark:
        pen.fillRect(x1, y1, x2 - x1, y2 - y1)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages of a set") / "images"
    draw(spark, root / "d1" / "1 first.png", "png", 200, 100, [(10, 10, 90, 30), (10, 60, 200, 80)])
    draw(spark, root / "d1" / "page" / "2.jpg", "jpg", 2560, 1280, [(0, 0, 2560, 640)])
    draw(spark, root / "d2" / "1.tif", "tiff", 300, 40, [(20, 8, 300, 32)])
    (root / "d2" / "2.png").write_bytes(b"no image")
    return str(root)


class Dark:
    """One box around each run of rows with dark pixels."""

    def segment_page(self, image):
        page = images.pixels(image)
        rows = np.flatnonzero(np.r_[False, (page[:, :, 1] < 128).any(axis=1), False][1:] != np.r_[False, (page[:, :, 1] < 128).any(axis=1), False][:-1])
        out = []
        for a, b in zip(rows[::2].tolist(), rows[1::2].tolist(), strict=True):
            columns = np.flatnonzero((page[a:b, :, 1] < 128).any(axis=0))
            out.append({"x1": int(columns[0]), "y1": a, "x2": int(columns[-1]) + 1, "y2": b, "width": page.shape[1], "height": page.shape[0]})
        return out


class Sizes:
    def recognize_lines(self, crops):
        assert all(isinstance(c, bytes) for c in crops)
        return ["x".join(map(str, images.pixels(c).shape[1::-1])) for c in crops]


@pytest.fixture
def registered():
    plugins.SEGMENTERS["dark"], plugins.RECOGNIZERS["sizes"] = Dark, Sizes
    yield
    del plugins.SEGMENTERS["dark"], plugins.RECOGNIZERS["sizes"]


def test_png_and_crop():
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (37, 53, 3), dtype=np.uint8)
    assert (images.pixels(images.png(page)) == page).all()
    assert (images.crop(page, (5, 6, 20, 30)) == page[6:30, 5:20]).all()
    beyond = images.crop(page, (-2, -3, 60, 40))
    assert beyond.shape == (43, 62, 3) and (beyond[3:40, 2:55] == page).all() and not beyond[:3].any()
    assert images.crop(page, (60, 60, 61, 61)).sum() == 0
    with pytest.raises(ValueError, match="not a PNG"):
        images.pixels(b"\xff\xd8")


@pytest.mark.parametrize("size,longest", [((100, 40), 50), ((40, 100), 33), ((3, 3000), 10), ((10, 10), 1280)])
def test_shrink(size, longest):
    w, h = size
    page = np.tile(np.linspace(0, 250, w).astype(np.uint8)[None, :, None], (h, 1, 3))
    small = images.shrink(page, longest)
    scale = min(1, longest / max(size))
    assert small.shape == (max(1, int(h * scale)), max(1, int(w * scale)), 3)
    assert abs(float(small.mean()) - float(page.mean())) < 3
    flat = np.full((h, w, 3), 77, np.uint8)
    assert (images.shrink(flat, longest) == 77).all()


def test_contents_of_a_folder(spark, folder):
    rows = {(r["id"], r["page"]): r for r in corpus.page_contents(spark, folder).collect()}
    assert set(rows) == {("d1", 0), ("d1", 1), ("d2", 0), ("d2", 1)}
    assert (rows["d1", 0]["width"], rows["d1", 0]["height"]) == (200, 100)
    assert (rows["d1", 1]["width"], rows["d1", 1]["height"]) == (1280, 640)  # the long side of a JPEG, shrunk
    assert rows["d2", 1]["content"] is None and rows["d2", 1]["width"] is None
    page = images.pixels(rows["d1", 0]["content"])
    assert page[5, 5].tolist() == [255, 255, 255] and page[20, 20].tolist() == [200, 10, 0]  # RGB, not BGR
    assert images.pixels(rows["d2", 0]["content"])[20, 100].tolist() == [200, 10, 0]
    assert "content" not in corpus.page_images(spark, folder).columns


def test_pages_are_recognised_as_bytes(spark, folder, registered):
    pages = corpus.page_contents(spark, folder)
    got = {r["id"]: (r["ocr"], r["num_pages"], r["num_lines"]) for r in plugins.recognize_documents(pages, "dark", "sizes", merge=None, padding=5).collect()}
    # padding stays within the image at its right edge
    assert got == {"d1": ("90x30\n195x30\n\n1280x325", 2, 3), "d2": ("285x34", 2, 1)}
    whole = {r["id"]: r["ocr"] for r in plugins.recognize_documents(pages, "passthrough", "sizes").collect()}
    assert whole == {"d1": "200x100\n\n1280x640", "d2": "300x40"}


def test_segmenter_is_a_table_function(spark, folder, registered):
    pages = corpus.page_contents(spark, folder)
    raw = plugins.segment(pages, "dark")
    assert "PythonUDTF" in raw._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["page"], r["pos"], r["x1"], r["y1"], r["x2"], r["y2"], r["width"], r["height"]) for r in raw.collect()}
    assert got == {("d1", 0, 0, 10, 10, 90, 30, 200, 100), ("d1", 0, 1, 10, 60, 200, 80, 200, 100), ("d1", 1, 0, 0, 0, 1280, 320, 1280, 640), ("d2", 0, 0, 20, 8, 300, 32, 300, 40)}
    lines = {(r["id"], r["page"], r["line_index"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in plugins.line_boxes(raw, None, padding=300).collect()}
    assert ("d2", 0, 0, 0, 0, 300, 40) in lines and ("d1", 0, 1, 0, 0, 200, 100) in lines


class Bytes:
    """Says what it was shown."""

    def __init__(self, settings=None):
        pass

    def generate(self, prompt, shown=None):
        return " ".join("x".join(map(str, images.pixels(i).shape[1::-1])) for i in shown)


def test_models_get_bytes(spark, folder):
    contents = corpus.image_contents(spark, folder)
    docs = corpus.page_images(spark, folder).withColumn("transcription", F.lit("one two three four")).where("id = 'd1'")
    got = {r["id"]: (r["prediction"], r["error"]) for r in align.align("m1", docs, plugins.ModelSettings("x"), factory=Bytes, contents=contents).collect()}
    assert got == {"d1": ("200x100\n1280x640", None)}
    example = F.array(F.struct(F.lit("e").alias("sample_id"), F.lit("a\nb").alias("gt_text"), F.lit("a b").alias("transcription"), F.lit(None).cast("string").alias("ocr_text"), F.array(F.concat(F.lit(f"{folder}/d2/1.tif"))).alias("image_paths")))
    shot = docs.withColumn("examples", example)
    got = align.align("m1", shot, plugins.ModelSettings("x"), examples=True, factory=Bytes, contents=contents).collect()
    assert got[0]["prediction"] == "300x40 200x100\n300x40 1280x640"  # examples before the page
    pages = plugins.transcribe_pages(corpus.page_images(spark, folder), plugins.ModelSettings("x"), factory=Bytes, contents=contents).collect()
    found = {r["id"]: r for r in pages}
    assert found["d1"]["prediction"] == "200x100\n1280x640" and "TypeError" in found["d2"]["error"] or "AttributeError" in found["d2"]["error"]


def test_rate_holds_over_tasks(spark, tmp_path):
    log = str(tmp_path / "calls")

    class Timed:
        def __init__(self, settings=None):
            pass

        def generate(self, prompt, shown=None):
            import time

            with open(log, "a") as f:
                f.write(f"{time.time()}\n")
            return "x"

    settings = plugins.ModelSettings("x", options={"requests_per_minute": 600, "tasks": 2})
    df = spark.createDataFrame([(i, "p") for i in range(24)], "id int, prompt string").repartition(5)
    plugins.generate(df, settings, factory=Timed).collect()
    at = sorted(map(float, open(log).read().split()))
    assert len(at) == 24
    for i, begin in enumerate(at):  # ten calls a second over both tasks
        assert sum(begin <= t < begin + 1 for t in at[i:]) <= 11


def test_shares_of_a_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    second = plugins.Throttle(60, clock=lambda: now[0], sleep=sleep, tasks=2, task=1)
    for _ in range(3):
        second.wait()
    assert slept == [1.0, 2.0, 2.0]  # after the first task's first call, then every other second
