"""Page layout: balanced page split, line merging, numbering, gaps, text assembly. All Catalyst folds, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import text as X
from quirefold.functions.folds import fold

#: Boxes as detectors give them; the field order makes array_sort order by (y1, x1, pos).
RAW = "struct<y1:int,x1:int,pos:int,x2:int,y2:int>"


def split_pages(text: Column, pages: Column) -> Column:
    """A text in `pages` chunks of about equal length at word borders, padded with empty chunks.

    One page or blank text keeps the stripped text as it is. A chunk closes when the next word would pass the
    target and pages are left; the rest is then shared anew (the space at the cut is not taken off).
    """
    state = "struct<at:int,begin:int,cuts:array<int>,len:bigint,rest:double,left:int>"

    def step(a: Column, n: Column) -> Column:
        inside = a["at"] > a["begin"]
        more = n + F.when(inside, 1).otherwise(0)
        close = inside & (a["len"] + more > a["rest"] / a["left"]) & (a["left"] > 1)
        pick = lambda yes, no: F.when(close, yes).otherwise(no)
        return F.struct(
            (a["at"] + 1).alias("at"),
            pick(a["at"], a["begin"]).alias("begin"),
            pick(F.concat(a["cuts"], F.array(a["at"])), a["cuts"]).alias("cuts"),
            pick(n, a["len"] + more).cast("bigint").alias("len"),
            pick(a["rest"] - a["len"], a["rest"]).alias("rest"),
            pick(a["left"] - 1, a["left"]).alias("left"),
        ).cast(state)

    def cut(words: Column) -> Column:
        """The fold carries numbers and the places of the few cuts; words are joined once, at the end."""
        sizes = F.transform(words, F.length)
        total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n) + F.size(words) - 1
        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("begin"), F.array().cast("array<int>").alias("cuts"), F.lit(0).cast("bigint").alias("len"), total.cast("double").alias("rest"), pages.cast("int").alias("left")).cast(state)
        places = F.aggregate(sizes, begin, step, lambda a: F.arrays_zip(F.concat(F.array(F.lit(0)), a["cuts"]).alias("a"), F.concat(a["cuts"], F.array(a["at"])).alias("b")))
        chunks = F.transform(places, lambda p: F.array_join(F.slice(words, p["a"] + 1, p["b"] - p["a"]), " "))
        return F.concat(chunks, F.array_repeat(F.lit(""), F.greatest(pages - F.size(places), F.lit(0)).cast("int")))

    def split(words: Column) -> Column:
        return F.when((pages <= 1) | (F.size(words) == 0), F.array(X.strip(text))).otherwise(cut(words))

    # An array of one binds the words to a name, so that they are made once.
    return F.element_at(F.transform(F.array(X.tokens(text)), split), 1)


def explode_made(df: DataFrame, keys: list[str], array: Column, at: str, item: str) -> DataFrame:
    """posexplode of a computed array of non-null items. A plain explode makes the optimizer filter on the array's size first, which repeats
    the whole computation below; the outer form is not filtered, and its empty rows go afterwards."""
    return df.select(*keys, F.posexplode_outer(array).alias(at, item)).where(F.col(item).isNotNull())


def page_chunks(df: DataFrame, text: str, images: str, htr: str | None = None) -> DataFrame:
    """One row per page that has text: page, image, chunk (and htr_chunk): positions of images and chunks zipped, the
    shorter side wins; empty chunks and their images are left out."""
    n = F.size(images)
    zipped = {"image": F.col(images), "chunk": split_pages(F.col(text), n)}
    if htr:
        zipped["htr_chunk"] = split_pages(F.coalesce(F.col(htr), F.lit("")), n)
    short = F.least(*[F.size(c) for c in zipped.values()])
    arrays = F.arrays_zip(*[F.slice(c, F.lit(1), short).alias(k) for k, c in zipped.items()])
    out = explode_made(df, ["*"], arrays, "page", "_z")
    out = out.select(*df.columns, "page", *[F.col(f"_z.{k}").alias(k) for k in zipped])
    return out.where("chunk <> ''")


def _merged(boxes: Column, joins) -> Column:
    """Left fold over sorted boxes: a box joins the open group's union or closes it and opens one."""

    def step(open_: Column, b: Column) -> tuple[Column, Column]:
        here = G.box(b["x1"], b["y1"], b["x2"], b["y2"])
        joined = open_.isNotNull() & joins(open_, here)
        return F.when(joined, G.union(open_, here)).otherwise(here), F.when(~joined, open_)

    end = lambda a: F.concat(a["items"], F.when(a["carry"].isNull(), F.array().cast(f"array<{G.BOX}>")).otherwise(F.array(a["carry"])))
    folded = F.transform(F.array(boxes), lambda all_: fold(all_, F.lit(None), G.BOX, G.BOX, step))  # an array of one binds the boxes to a name
    return F.element_at(F.transform(folded, end), 1)


def _tallest(boxes: Column) -> Column:
    """The first box of the greatest height."""
    best = F.array_max(F.transform(boxes, G.height))
    return F.slice(F.filter(boxes, lambda b: G.height(b) == best), 1, 1)


def merge_lines(df: DataFrame, boxes: str, out: str = "lines", overlap: float = 0.4, gap_ratio: float = 0.5, min_height: float = 0.3) -> DataFrame:
    """Adaptive merging of detected boxes (array of RAW) to text lines, sorted by (y1, x1).

    Reference height: the upper quartile of heights (the upper median below 4 boxes). Boxes of at most a fifth of it
    go; a box joins the running line where they overlap enough or the gap is small, by the median gap of the page. Lines below
    the least height go. Where nothing stays, the tallest box or line does.
    """
    cast = f"array<{RAW}>"
    df = df.withColumn("_b", F.array_sort(F.col(boxes).cast(cast)))
    heights = F.transform("_b", G.height)
    quartile = G.upper_order_statistic(heights, 3, 4)
    df = df.withColumn("_ref", F.when(F.size("_b") >= 4, quartile).otherwise(G.upper_order_statistic(heights)))
    df = df.withColumn("_kept", F.filter("_b", lambda b: G.height(b) > (F.col("_ref") * 0.2).cast("int")))
    pairs = F.when(F.size("_kept") > 1, F.zip_with(F.slice("_kept", F.lit(1), F.size("_kept") - 1), F.slice("_kept", F.lit(2), F.size("_kept")), G.vertical_gap)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_gaps", F.filter(pairs, lambda g: g >= 0))
    base = (F.col("_ref") * gap_ratio).cast("int")
    df = df.withColumn("_max", F.when(F.size("_gaps") > 0, F.least((G.upper_order_statistic(F.col("_gaps")) * 0.3).cast("int"), base)).otherwise(base))
    joins = lambda a, b: (G.vertical_overlap(a, b) >= overlap) | G.vertical_gap(a, b).between(F.lit(0), F.col("_max"))
    df = df.withColumn("_m", _merged(F.col("_kept"), joins))
    tall = F.filter("_m", lambda b: G.height(b) >= (F.col("_ref") * min_height).cast("int"))
    plain = F.transform(_tallest(F.col("_b")), lambda b: G.box(b["x1"], b["y1"], b["x2"], b["y2"]))
    chosen = F.when(F.size("_kept") == 0, plain).when(F.size(tall) > 0, tall).otherwise(_tallest(F.col("_m")))
    order = F.array_sort(F.transform(chosen, lambda b: F.struct(b["y1"].alias("y1"), b["x1"].alias("x1"), b["x2"].alias("x2"), b["y2"].alias("y2"))))
    lines = F.transform(order, lambda b: G.box(b["x1"], b["y1"], b["x2"], b["y2"]))
    df = df.withColumn(out, F.when(F.size("_b") > 0, lines).otherwise(F.array().cast(f"array<{G.BOX}>")))
    return df.drop("_b", "_ref", "_kept", "_gaps", "_max", "_m")


def merge_same_line(boxes: Column, image_height: Column, overlap: float = 0.3, min_share: float = 0.02) -> Column:
    """Words (array of RAW) to lines: boxes of at least a share of the image's height, joined by overlap alone."""
    kept = F.filter(F.array_sort(boxes.cast(f"array<{RAW}>")), lambda b: G.height(b) >= (image_height * min_share).cast("int"))
    return _merged(kept, lambda a, b: G.vertical_overlap(a, b) >= overlap)


def number_lines(df: DataFrame, page: str = "page", start: int = 0) -> DataFrame:
    """Index of each box within its page by (y1, x1), and the gap to the next box of the page."""
    line = Window.partitionBy(page).orderBy("y1", "x1", "x2", "y2")
    here = F.struct("y1", "y2")
    following = F.lead(here).over(line)
    gap = F.when(following.isNotNull(), G.vertical_gap(here, following))
    return df.withColumn("line_index", (F.row_number().over(line) - 1 + start).cast("int")).withColumn("gap", gap)


def reading_order(words: Column) -> Column:
    """Words {min_x, pos, text} by left edge, first come first where equal, joined by spaces; no left edge counts as 0."""
    keyed = F.transform(words, lambda w: F.struct(F.coalesce(w["min_x"], F.lit(0.0)).alias("min_x"), w["pos"].alias("pos"), w["text"].alias("text")))
    return X.strip(F.array_join(F.transform(F.array_sort(keyed), lambda w: w["text"]), " "))


def assemble(lines_df: DataFrame) -> DataFrame:
    """Recognised lines (id, page, line_index, text; null line_index for a page without lines) to documents: id, ocr, num_pages, num_lines."""
    per_page = lines_df.groupBy("id", "page").agg(F.sort_array(F.collect_list(F.when(F.col("line_index").isNotNull(), F.struct("line_index", "text")))).alias("l"))
    text = X.join_lines(F.transform("l", lambda x: x["text"]))
    per_page = per_page.select("id", "page", text.alias("t"), F.size("l").alias("n"))
    docs = per_page.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("page", "t"))).alias("p"), F.count(F.lit(1)).alias("num_pages"), F.sum("n").alias("num_lines"))
    return docs.select("id", X.join_pages(F.transform("p", lambda x: x["t"])).alias("ocr"), "num_pages", "num_lines")
