"""Converters: form XML, coded transcriptions, one-cell-per-line CSV, attribute XML manifests, page images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions import geometry as G
from quirefold.functions import naming
from quirefold.functions import text as X
from quirefold.operators import layout

#: Schema of <form> rows; attributes carry an underscore.
FORM = (
    "_id string, _width int, _height int, "
    "`machine-printed-part` struct<`machine-print-line`:array<struct<_text:string>>>, "
    "`handwritten-part` struct<line:array<struct<_id:string,_text:string,"
    "word:array<struct<_text:string,cmp:array<struct<_x:int,_y:int,_width:int,_height:int>>>>>>>"
)
LINE_ID = r"^(\d+)-(\d+)-(\d+)$"


def gt_and_transcription(df: DataFrame, id_: Column, lines: Column, end: str = "") -> DataFrame:
    """(id, gt, transcription) of arrays of lines; blank lines go, documents without lines too."""
    kept = F.filter(F.transform(lines, X.strip), lambda x: x.isNotNull() & (x != ""))
    out = df.select(id_.alias("id"), kept.alias("_lines")).where(F.size("_lines") > 0)
    return out.select("id", F.concat(F.array_join("_lines", "\n"), F.lit(end)).alias("gt"), F.concat(F.array_join("_lines", " "), F.lit(end)).alias("transcription"))


def form_boxes(forms: DataFrame) -> DataFrame:
    """(id, handwritten, printed): crop boxes of the two parts; handwritten is null without components."""
    words = F.flatten(F.transform(F.coalesce(F.col("handwritten-part.line"), F.array()), lambda line: F.coalesce(line["word"], F.array())))
    parts = F.flatten(F.transform(words, lambda w: F.coalesce(w["cmp"], F.array())))
    boxes = F.transform(parts, lambda c: G.box(c["_x"], c["_y"], c["_x"] + c["_width"], c["_y"] + c["_height"]))
    df = forms.select(F.col("_id").alias("id"), F.col("_width").alias("w"), G.union_all(boxes).alias("b"))
    hand = F.when(F.col("b").isNotNull(), G.pad(F.col("b"), 10))
    df = df.withColumn("handwritten", hand)
    return df.select("id", "handwritten", G.printed_part(F.col("handwritten"), F.col("w")).alias("printed"))


def convert_forms(forms: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(handwritten, printed): id, gt, transcription, box. With images (id), forms without one are left out."""
    if images is not None:
        forms = forms.join(images.select(F.col("id").alias("_id")).distinct(), "_id", "left_semi")
    boxes = form_boxes(forms)
    hand = F.transform(F.coalesce(F.col("handwritten-part.line"), F.array()), lambda x: x["_text"])
    machine = F.transform(F.coalesce(F.col("machine-printed-part.machine-print-line"), F.array()), lambda x: x["_text"])
    made = [gt_and_transcription(forms, F.col("_id"), lines).join(boxes.select("id", F.col(b).alias("box")), "id") for lines, b in ((hand, "handwritten"), (machine, "printed"))]
    return made[0], made[1]


def convert_coded(rows: DataFrame) -> DataFrame:
    """Coded lines (value, pos) to (id, gt, transcription): `page-line code`; blank and one-field lines are skipped, order is file order.

    Texts end with a newline.
    """
    parts = F.split(X.strip(F.col("value")), rf"{X.WS}+", 2)
    df = rows.select("pos", parts.alias("p")).where(F.size("p") == 2)
    df = df.select("pos", F.substring_index(F.col("p")[0], "-", 1).alias("id"), naming.decode_line(F.col("p")[1]).alias("line"))
    pages = df.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    lines = F.transform("l", lambda x: x["line"])
    return pages.select("id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("gt"), F.concat(F.array_join(lines, " "), F.lit("\n")).alias("transcription"))


def convert_cells(table: DataFrame) -> DataFrame:
    """Rows with ID and cells (a map of _0.._k, of which any may be missing) to (id, gt, transcription). Cells go in the order of their names as
    strings, so _10 comes before _2: results that exist were made so."""
    named = F.array_sort(F.filter(F.map_entries("cells"), lambda e: e["key"].startswith("_")))
    return gt_and_transcription(table, F.col("ID"), F.transform(named, lambda e: e["value"]))


def decode_xml(content: Column) -> Column:
    """XML bytes as text: byte order mark, else NULs among the first 200 bytes, else UTF-8, else Latin-1."""
    head = F.hex(F.substring(content, 1, 2))
    start = F.hex(F.substring(content, 1, 200))
    pairs = F.filter(F.split(start, "(?<=\\G.{2})"), lambda b: b != "")
    even = F.exists(pairs, lambda b: b == "00")
    first_nul = F.get(pairs, F.lit(0)) == "00"
    utf16 = F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(even & first_nul, F.decode(content, "UTF-16BE")).when(even, F.decode(content, "UTF-16LE"))
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.coalesce(utf16, utf8, F.decode(content, "ISO-8859-1"))


WORD = T.StructType([T.StructField("min_x", T.DoubleType()), T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())])
REGIONS = T.ArrayType(T.StructType([T.StructField("line_id", T.StringType()), T.StructField("words", T.ArrayType(WORD))]))


@F.pandas_udf(REGIONS)
def attribute_regions(xml: pd.Series) -> pd.Series:
    """Handwritten line regions of attribute XML at any depth, with their words. An XML parser is needed: the nesting is unbounded."""
    from xml.etree import ElementTree

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def number(value: str | None) -> float:
        try:
            return float(value or 0)
        except ValueError:
            return 0.0

    def left(word) -> float:
        rect = next((c for c in word if local(c.tag) == "minAreaRect"), ())
        return min((number(p.get("x")) for p in rect if local(p.tag) == "Point"), default=0.0)

    def regions(text: str | None) -> list:
        if not text:
            return []
        out = []
        for e in ElementTree.fromstring(text).iter():
            if local(e.tag) == "AttrRegion" and e.get("attrType") == "2" and e.get("fontType") == "2":
                words = [w for w in e if local(w.tag) == "AttrRegion" and w.get("attrType") == "1" and w.get("fontType") == "2"]
                out.append({"line_id": e.get("id"), "words": [{"min_x": left(w), "pos": i, "text": w.get("text")} for i, w in enumerate(words)]})
        return out

    return xml.map(regions)


def attribute_lines(files: DataFrame, text_number: str) -> DataFrame:
    """(writer, line_id, text) of attribute XML (xml: string) of one text: words by left edge, joined by spaces."""
    df = files.select(F.explode(attribute_regions(F.col("xml"))).alias("r"))
    df = df.select(X.strip(F.col("r.line_id")).alias("line_id"), F.col("r.words").alias("w"))
    df = df.where(F.col("line_id").rlike(LINE_ID) & (F.regexp_extract("line_id", LINE_ID, 2) == text_number))
    words = F.transform("w", lambda w: F.struct(w["min_x"].alias("min_x"), w["pos"].alias("pos"), X.strip(F.coalesce(w["text"], F.lit(""))).alias("text")))
    text = layout.reading_order(F.filter(words, lambda w: w["text"] != ""))
    return df.select(F.regexp_extract("line_id", LINE_ID, 1).alias("writer"), "line_id", text.alias("text")).where("text <> ''")


def line_image(root: str, split: str, line_id: Column) -> Column:
    return F.concat_ws("/", F.lit(root), F.lit(split), F.lit("lines"), F.regexp_extract(line_id, LINE_ID, 1), F.concat(line_id, F.lit(".tif")))


def manifest(lines: DataFrame, min_words: int = 1, images: DataFrame | None = None, max_lines: int | None = None, ratio: float = 0.1, seed: int = 13, validation: DataFrame | None = None) -> DataFrame:
    """Lines (writer, image_path, text) with `part`: train or val, by a hash of the writer or a given list of writers."""
    df = lines.where(F.size(X.tokens(F.col("text"))) >= min_words)
    if images is not None:
        df = df.join(images.select("image_path").distinct(), "image_path", "left_semi")
    if max_lines is not None:
        df = df.orderBy("image_path").limit(max_lines)
    if validation is not None:
        listed = validation.select("writer").distinct().withColumn("_val", F.lit(True))
        return df.join(listed, "writer", "left").withColumn("part", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")
    return df.withColumn("part", F.when(naming.in_validation(F.col("writer"), ratio, seed), "val").otherwise("train"))


def manifest_stats(df: DataFrame) -> DataFrame:
    """Per part: count, average words and characters, writers; zeros for a part without lines."""
    parts = df.sparkSession.createDataFrame([("train",), ("val",)], "part string")
    stats = df.groupBy("part").agg(F.count(F.lit(1)).alias("count"), F.avg(F.size(X.tokens(F.col("text")))).alias("avg_words"), F.avg(F.length("text")).alias("avg_chars"), F.countDistinct("writer").alias("writers"))
    zero = F.lit(0)
    return parts.join(stats, "part", "left").select("part", F.coalesce("count", zero).alias("count"), F.coalesce("avg_words", F.lit(0.0)).alias("avg_words"), F.coalesce("avg_chars", F.lit(0.0)).alias("avg_chars"), F.coalesce("writers", zero).alias("writers"))


def page_folders(files: DataFrame, target: str = "images") -> DataFrame:
    """(id, source, destination) of flat page images: the id is the digits of the stem; other files are left out."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    df = files.withColumn("id", naming.page_digits(naming.stem(F.col("path")))).where(ext.isin(".jpg", ".jpeg", ".png", ".tif", ".tiff") & (F.col("id") != ""))
    return df.select("id", F.col("path").alias("source"), F.concat_ws("/", F.lit(target), F.col("id"), F.element_at(F.split("path", "/"), -1)).alias("destination"))
