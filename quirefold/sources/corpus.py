"""Sources: one file per document, image listings, tables of results, XML, coded text. All explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import images
from quirefold.functions import text as X
from quirefold.functions.naming import stem
from quirefold.operators.converters import FORM, decode_xml

#: Image extensions in the order the listings prefer: fixed values.
SHARED_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff")
CROP_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff")
#: Data sets and what reads them by default: fixed values.
REGISTRY = {
    "bullinger_handwritten": ("kraken", "trocr_handwritten"),
    "bullinger_print": ("kraken", "trocr_printed"),
    "easy_historical": ("kraken", "trocr_handwritten"),
    "IAM_handwritten": ("kraken", "trocr_handwritten"),
    "IAM_print": ("kraken", "trocr_printed"),
    "children_handwritten": ("kraken", "trocr_handwritten"),
}
META = "id string, dataset string, segmenter string, recognizer string, recognizer_model string, num_pages int, num_lines int, timestamp_utc string, cache_root string, ocr_path string, transcription_path string"
RESULT = (
    "id string, len_gt string, len_pred string, wer string, cer string, wer_norm string, cer_norm string, line_acc string, line_acc_norm string, "
    "rev_line_acc string, rev_line_acc_norm string, exact_line_precision string, exact_line_recall string, exact_line_f1 string, "
    "exact_line_precision_norm string, exact_line_recall_norm string, exact_line_f1_norm string"
)
CHECKPOINT = "method string, dataset string, model string, n_shots int, processed_ids array<string>, rows array<array<string>>, sums map<string,double>, checkpoint_path string"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REGISTRY.items()], "name string, segmenter string, recognizer string")


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, so any store Spark reads will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_files(spark: SparkSession, folder: str, name: str = "text", stripped: bool = False) -> DataFrame:
    """(id, <name>) of <folder>/*.txt, newlines unified; the legacy drivers strip the text."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    value = X.unify_newlines(F.col("value"))
    return df.select(stem(F.col("_metadata.file_name")).alias("id"), (X.strip(value) if stripped else value).alias(name))


def sample_ids(spark: SparkSession, root: str, wanted: list[str] | None = None) -> DataFrame:
    """Ids of a dataset: from gt, else transcription, else the image folders, by which folder exists; sorted."""
    if exists(spark, f"{root}/gt"):
        ids = text_files(spark, f"{root}/gt").select("id")
    elif exists(spark, f"{root}/transcription"):
        ids = text_files(spark, f"{root}/transcription").select("id")
    elif exists(spark, f"{root}/images"):
        paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/images").select("path")
        ids = paths.select(F.regexp_extract("path", r"/images/([^/]+)/", 1).alias("id")).where("id <> ''").distinct()
    else:
        ids = spark.createDataFrame([], "id string")
    return (ids.where(F.col("id").isin(wanted)) if wanted is not None else ids).orderBy("id")


def id_list(spark: SparkSession, argument: str | None) -> list[str] | None:
    """An existing file: one id per line; else a list with commas. Blanks are dropped. A command-line argument, so a driver-side list."""
    if argument is None:
        return None
    if exists(spark, argument):
        found = [r[0] for r in spark.read.text(argument).collect()]
    else:
        found = argument.split(",")
    return [x.strip() for x in found if x.strip()]


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a folder; contents are never read, the column is pruned."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def _below(spark: SparkSession, root: str) -> Column:
    """The part of `path` below a folder, whatever the folder's name holds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    return F.substring("path", len(whole) + 2, 2**31 - 1)


def page_images(spark: SparkSession, root: str) -> DataFrame:
    """(id, images): images in <root>/<id> and <root>/<id>/page, sorted by path parts."""
    at = F.regexp_extract("path", r"/([^/]+)(?:/page)?/[^/]+$", 1)
    ext = F.regexp_extract("path", r"\.([^./]*)$", 1)
    depth = _below(spark, root)
    df = _listing(spark, root).where(ext.isin(*SHARED_EXTENSIONS) & depth.rlike(r"^[^/]+/(?:page/)?[^/]+$"))
    parts = F.sort_array(F.collect_list(F.struct(F.split("path", "/").alias("parts"), "path")))
    return df.groupBy(at.alias("id")).agg(F.transform(parts, lambda x: x["path"]).alias("images"))


def legacy_page_images(spark: SparkSession, root: str) -> DataFrame:
    """(id, images): folders <id>, then page, images, img within; by extension order, then name; any depth where those are empty; no repeats."""
    rest = _below(spark, root)
    inner = F.regexp_replace(F.regexp_replace(rest, r"^[^/]+/", ""), r"[^/]+$", "")
    rank = F.when(inner == "", 0).when(inner == "page/", 1).when(inner == "images/", 2).when(inner == "img/", 3).otherwise(9)
    ext = F.array_position(F.array(*[F.lit(x) for x in SHARED_EXTENSIONS]), F.regexp_extract("path", r"\.([^./]*)$", 1))
    df = _listing(spark, root).select(F.substring_index(rest, "/", 1).alias("id"), rank.alias("rank"), ext.alias("ext"), "path").where("ext > 0")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "ext", "path")))
    df = df.groupBy("id").agg(ordered.alias("p"))
    near = F.filter("p", lambda x: x["rank"] < 9)
    chosen = F.when(F.size(near) > 0, near).otherwise(F.col("p"))
    return df.select("id", F.array_distinct(F.transform(chosen, lambda x: x["path"])).alias("images"))


def _place(path: Column) -> Column:
    """A path by which two sources' names of one file agree (file:/x, file:///x and /x are the same)."""
    return F.regexp_replace(path, "^file:/+", "/")


def image_contents(spark: SparkSession, root: str, longest: int = 1280) -> DataFrame:
    """(path, width, height, content) of the images below a folder in any store that Spark reads: PNG with no side over `longest`."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SHARED_EXTENSIONS) + "}").load(root)
    path = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))  # this source gives URL-encoded names
    return images.prepared(found.select(path.alias("path"), "image.height", "image.width", "image.nChannels", "image.data"), longest)


def with_contents(df: DataFrame, keys: list[str], paths: str, contents: DataFrame, out: str) -> DataFrame:
    """df (keys unique) with `out`: the contents of an array of paths, in its order; a path without content gives null. Paths meet contents by one join."""
    each = df.select(*keys, F.posexplode_outer(paths).alias("_pos", "_path")).withColumn("_place", _place(F.col("_path")))
    held = contents.select(_place(F.col("path")).alias("_place"), "content")
    got = each.join(held, "_place", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "content")))).alias("_c"))
    return df.join(got.select(*keys, F.transform("_c", lambda x: x["content"]).alias(out)), keys)


def page_contents(spark: SparkSession, root: str, longest: int = 1280) -> DataFrame:
    """Pages (id, page, image, width, height, content) of a folder of documents, numbered as page_images() orders them."""
    pages = page_images(spark, root).select("id", F.posexplode("images").alias("page", "image")).withColumn("_place", _place(F.col("image")))
    held = image_contents(spark, root, longest).withColumn("_place", _place(F.col("path")))
    return pages.join(held, "_place", "left").select("id", "page", "image", "width", "height", "content")


def line_crops(spark: SparkSession, root: str) -> DataFrame:
    """(page, crops): existing crops in <root>/<page>/, by extension order, then name."""
    ext = F.array_position(F.array(*[F.lit(x) for x in CROP_EXTENSIONS]), F.regexp_extract("path", r"\.([^./]*)$", 1))
    df = _listing(spark, root).select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("page"), ext.alias("ext"), "path").where("ext > 0")
    return df.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("ext", "path"))), lambda x: x["path"]).alias("crops"))


def crops_or_page(pages: DataFrame, crops: DataFrame) -> DataFrame:
    """Existing crops of a page, else the whole page as one crop."""
    page = F.regexp_extract("image", r"([^/]+?)(?:\.[^./]*)?$", 1)
    df = pages.withColumn("page", page).join(crops, "page", "left")
    return df.withColumn("crops", F.coalesce("crops", F.array("image")))


def corpus(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """(dataset, id, gt, transcription, ocr) of a dataset folder; missing texts are null."""
    df = text_files(spark, f"{root}/gt", "gt")
    for name in ("transcription", "ocr"):
        more = text_files(spark, f"{root}/{name}", name) if exists(spark, f"{root}/{name}") else spark.createDataFrame([], f"id string, {name} string")
        df = df.join(more, "id", "left")
    return df.select(F.lit(dataset).alias("dataset"), "id", "gt", "transcription", "ocr")


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation CSV rows with `file` (stem) and `_pos`; blank lines vanish, values stay strings."""
    df = spark.read.schema(RESULT).csv(folder, header=True, pathGlobFilter="*.csv", enforceSchema=True)
    return df.select("*", stem(F.col("_metadata.file_name")).alias("file"), F.monotonically_increasing_id().alias("_pos"))


def cell_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ID, Category, cells) of CSV files of different width: cells maps the other columns' names to their values, missing ones left out.

    All files are one scan without a header; a file's first row names the columns of its rows.
    """
    wide = spark.read.text(paths).agg(F.max(F.regexp_count("value", F.lit(",")))).first()[0]  # no row has more cells than a line has commas
    names = [f"_{i}" for i in range((wide or 0) + 1)]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(paths, multiLine=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.array(*names).alias("row"))
    first = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", F.first("row").over(first)).withColumn("begin", F.min("pos").over(first)).where("pos > begin")
    pairs = F.filter(F.arrays_zip(F.col("head").alias("k"), F.col("row").alias("v")), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    one = lambda name: F.get(F.filter("pairs", lambda x: x["k"] == name), F.lit(0))["v"].alias(name)
    cells = F.map_from_entries(F.filter("pairs", lambda x: ~x["k"].isin("ID", "Category")))
    return rows.select(pairs.alias("pairs")).select(one("ID"), one("Category"), cells.alias("cells"))


def line_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, text) of a TSV without header or quotes; incomplete lines are dropped."""
    parts = F.split(X.strip(F.col("value")), "\t", 2)
    df = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 2)
    df = df.select(X.strip(F.col("p")[0]).alias("image_path"), X.strip(F.col("p")[1]).alias("text"))
    return df.where("image_path <> '' and text <> ''")


def forms(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag="form", charset="ISO-8859-1", pathGlobFilter="*.xml").schema(FORM).load(folder)


def attribute_xml(spark: SparkSession, folder: str, text_number: str) -> DataFrame:
    """(name, xml) of the attribute files of one text, in any of the encodings met."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*-{text_number}_attributes.xml").load(folder)
    return df.select(stem(F.col("path")).alias("name"), F.regexp_replace(decode_xml(F.col("content")), r"^﻿?\s*<\?xml[^>]*\?>", "").alias("xml"))


def coded_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, pos): lines of a coded transcription in file order."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.posexplode(F.split(X.unify_newlines(F.col("value")), "\n")).alias("pos", "value"))


def flat_images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path")


def ocr_meta(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(META).json(folder, multiLine=True, pathGlobFilter="*.meta.json")


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """A checkpoint's state; an empty table where the file is missing or corrupt."""
    if not exists(spark, path):
        return spark.createDataFrame([], CHECKPOINT)
    return spark.read.schema(CHECKPOINT).json(path, multiLine=True, mode="DROPMALFORMED").where("processed_ids is not null")
