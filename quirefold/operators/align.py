"""Line-break alignment: the three prompted methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import prompts
from quirefold.functions import text as X
from quirefold.operators import layout
from quirefold.operators.fewshot import prompt_images
from quirefold.operators.plugins import Backend, ModelSettings, generate
from quirefold.sources.corpus import with_contents


def prompts_for(method: str, df: DataFrame, examples: bool = False) -> DataFrame:
    """One row per model call with `prompt` (and `images`): per page with text for m1 and m2, per document for m3."""
    shown = F.col("examples") if examples else None
    if method == "m3":
        return df.withColumn("prompt", prompts.render("m3", F.col("transcription"), F.col("ocr"), shown))
    rows = layout.page_chunks(df, "transcription", "images", "ocr" if method == "m2" else None)
    htr = F.col("htr_chunk") if method == "m2" else None
    rows = rows.withColumn("prompt", prompts.render(method, F.col("chunk"), htr, shown))
    return rows.withColumn("images", prompt_images("examples", "image") if examples else F.array("image"))


def align(method: str, df: DataFrame, settings: ModelSettings, backend: str | None = None, examples: bool = False, factory: Callable[[ModelSettings], Backend] | None = None, contents: DataFrame | None = None) -> DataFrame:
    """(id, prediction, error) by a model. m3 leaves a blank transcription blank without a call; pages join by one LF.

    A document fails as a whole if one of its calls does. contents: of sources.corpus.image_contents(); models then get the
    images of a call, examples before the page, as bytes in place of paths.
    """
    if method == "m3":
        blank = X.strip(F.col("transcription")) == ""
        asked = generate(prompts_for("m3", df.where(~blank), examples), settings, backend=backend, factory=factory)
        done = asked.select("id", F.col("value").alias("prediction"), "error")
        return done.unionByName(df.where(blank).select("id", F.lit("").alias("prediction"), F.lit(None).cast("string").alias("error")))
    asked = prompts_for(method, df, examples).select("id", "page", "prompt", "images")
    if contents is not None:
        asked = with_contents(asked, ["id", "page"], "images", contents, "contents").drop("images").withColumnRenamed("contents", "images")
    calls = generate(asked, settings, images="images", backend=backend, factory=factory)
    pages = F.sort_array(F.collect_list(F.struct("page", "value", "error")))
    docs = calls.groupBy("id").agg(pages.alias("p")).select("id", "p", F.array_join(F.filter(F.transform("p", lambda x: x["error"]), lambda e: e.isNotNull()), "; ").alias("e"))
    error = F.when(F.col("e") != "", F.col("e"))
    text = X.join_outputs(F.transform("p", lambda x: x["value"]))
    found = docs.select("id", F.when(error.isNull(), text).alias("prediction"), error.alias("error"))
    rest = df.select("id").join(asked.select("id"), "id", "left_anti")  # documents without any page text; no model is called for this
    return found.unionByName(rest.select("id", F.lit("").alias("prediction"), F.lit(None).cast("string").alias("error")))
