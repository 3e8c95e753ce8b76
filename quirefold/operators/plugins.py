"""Model calls as Arrow-batched functions: backends, segmenters, recognizers behind registries.

A plugin is made once per task from its settings and then called per batch. Failures are kept per record
as {value, error}. A spent daily quota is such a failure too: the rest of the task's rows get it without a call, finished rows
stay, and raise_if_spent() stops the run on the driver once they are committed (see streaming.incremental).
"""

from __future__ import annotations

import base64
import io
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import images
from quirefold.functions.text import DAILY_SIGNS


class QuotaExhausted(RuntimeError):
    """A daily quota is spent; running on later makes sense, retrying now does not."""

    #: Exit code that asks a scheduler to submit again: fixed value.
    EXIT_CODE = 75
    #: How the error of a row begins that was stopped by a quota.
    SIGN = "QuotaExhausted: "


class Transient(RuntimeError):
    """A failure worth retrying (rate limit or server side)."""


#: An image as plugins get it: the bytes of a prepared PNG, or the path of a file on a mount that all executors share.
Image = str | bytes


class Backend(Protocol):
    def generate(self, prompt: str, images: list[Image] | None = None) -> str: ...


class Segmenter(Protocol):
    def segment_page(self, image: Image) -> list[dict]: ...


class Recognizer(Protocol):
    def recognize_lines(self, crops: list[Image]) -> list[str]: ...


@dataclass(frozen=True)
class ModelSettings:
    model_id: str
    max_new_tokens: int = 2048
    temperature: float = 0.0
    device: str | None = None
    options: dict = field(default_factory=dict)

    @property
    def provider(self) -> str:
        head = self.model_id.split("/", 1)[0].lower()
        return head if "/" in self.model_id and head in ("openai", "hf", "gemini", "mistral") else "hf"

    @property
    def name(self) -> str:
        head, _, rest = self.model_id.partition("/")
        return rest if rest and head.lower() in ("openai", "hf", "gemini", "mistral") else self.model_id


BACKENDS: dict[str, Callable[[ModelSettings], Backend]] = {}
SEGMENTERS: dict[str, Callable[..., Segmenter]] = {}
RECOGNIZERS: dict[str, Callable[..., Recognizer]] = {}


def register(table: dict, name: str):
    def add(factory):
        table[name] = factory
        return factory

    return add


def make(table: dict, name: str, *args, **kwargs):
    if name not in table:
        raise ValueError(f"unknown plugin {name!r}; known: {', '.join(sorted(table))}")
    return table[name](*args, **kwargs)


def fit_within(image, longest: int = 1280):
    """A Pillow image with no side over `longest`, its proportions kept."""
    side = max(image.size)
    return image if side <= longest else image.resize(tuple(int(x * longest / side) for x in image.size))


def image_file(image: Image):
    """What image libraries open: bytes as a stream, a path without the scheme of local files."""
    return io.BytesIO(image) if isinstance(image, bytes) else re.sub("^file:/+", "/", image)


def open_image(image: Image, longest: int = 1280):
    from PIL import Image as Pillow

    return fit_within(Pillow.open(image_file(image)).convert("RGB"), longest)


def png_bytes(image: Image, longest: int = 1280) -> bytes:
    """A PNG with no side over `longest`: prepared bytes as they are, files by way of Pillow."""
    if isinstance(image, bytes):
        return image
    out = io.BytesIO()
    open_image(image, longest).save(out, format="PNG")
    return out.getvalue()


def image_url(image: Image) -> str:
    return "data:image/png;base64," + base64.b64encode(png_bytes(image)).decode()


@register(BACKENDS, "openai")
class OpenAIBackend:
    def __init__(self, settings: ModelSettings):
        import openai

        self.client, self.s = openai.OpenAI(), settings

    def generate(self, prompt: str, images: list[Image] | None = None) -> str:
        content = [*({"type": "image_url", "image_url": {"url": image_url(i), "detail": "high"}} for i in images or []), {"type": "text", "text": prompt}]
        got = self.client.chat.completions.create(model=self.s.name, messages=[{"role": "user", "content": content}], max_tokens=self.s.max_new_tokens, temperature=self.s.temperature)
        return (got.choices[0].message.content or "").strip()


@register(BACKENDS, "mistral")
class MistralBackend:
    def __init__(self, settings: ModelSettings):
        import mistralai

        self.client, self.s = mistralai.Mistral(api_key=settings.options.get("api_key")), settings

    def generate(self, prompt: str, images: list[Image] | None = None) -> str:
        content = [*({"type": "image_url", "image_url": image_url(i)} for i in images or []), {"type": "text", "text": prompt}]
        got = self.client.chat.complete(model=self.s.name, messages=[{"role": "user", "content": content}], max_tokens=self.s.max_new_tokens, temperature=self.s.temperature)
        return (got.choices[0].message.content or "").strip()


@register(BACKENDS, "gemini")
class GeminiBackend:
    def __init__(self, settings: ModelSettings):
        from google import genai

        self.client, self.s = genai.Client(api_key=settings.options.get("api_key")), settings
        self.limit = Throttle(PER_MINUTE["gemini"])  # generate() puts the task's share in its place

    def generate(self, prompt: str, images: list[Image] | None = None) -> str:
        from google.genai import types

        def once() -> str:
            self.limit.wait()
            parts = [*(types.Part.from_bytes(data=png_bytes(i), mime_type="image/png") for i in images or []), prompt]
            got = self.client.models.generate_content(model=self.s.name, contents=parts, config=types.GenerateContentConfig(max_output_tokens=self.s.max_new_tokens, temperature=self.s.temperature))
            return (got.text or "").strip()

        return with_retries(once)


@register(BACKENDS, "hf")
class LocalBackend:
    """A local model: in 4 bits on a GPU unless options["load_in_4bit"] is False; images at most options["max_side"] wide or high."""

    def __init__(self, settings: ModelSettings):
        import torch
        from transformers import AutoModelForImageTextToText, AutoProcessor

        self.torch, self.s = torch, settings
        self.processor = AutoProcessor.from_pretrained(settings.name)
        more = {}
        if settings.options.get("load_in_4bit", torch.cuda.is_available()):
            from transformers import BitsAndBytesConfig

            more["quantization_config"] = BitsAndBytesConfig(load_in_4bit=True, bnb_4bit_compute_dtype=torch.float16, bnb_4bit_quant_type="nf4", bnb_4bit_use_double_quant=True)
        self.model = AutoModelForImageTextToText.from_pretrained(settings.name, device_map=settings.device or "auto", **more)

    def generate(self, prompt: str, images: list[Image] | None = None) -> str:
        shown = [{"type": "image", "image": open_image(i, self.s.options.get("max_side", 1280))} for i in images or []]
        chat = [{"role": "user", "content": [*shown, {"type": "text", "text": prompt}]}]
        inputs = self.processor.apply_chat_template(chat, tokenize=True, add_generation_prompt=True, return_dict=True, return_tensors="pt").to(self.model.device)
        with self.torch.inference_mode():
            out = self.model.generate(**inputs, max_new_tokens=self.s.max_new_tokens, do_sample=False, repetition_penalty=1.05)
        return self.processor.batch_decode(out[:, inputs["input_ids"].shape[1] :], skip_special_tokens=True)[0].strip()


@register(BACKENDS, "echo")
class EchoBackend:
    """Returns what follows the last blank line of a prompt: for tests and dry runs."""

    def __init__(self, settings: ModelSettings | None = None):
        pass

    def generate(self, prompt: str, images: list[Image] | None = None) -> str:
        return prompt.rsplit("\n\n", 1)[-1]


@register(SEGMENTERS, "passthrough")
class PassthroughSegmenter:
    """The whole page as one line; existing crops are joined on by recognize_documents()."""

    def segment_page(self, image: Image) -> list[dict]:
        return [{"path": image if isinstance(image, str) else None, "x1": None, "y1": None, "x2": None, "y2": None, "height": None, "confidence": None}]


@register(SEGMENTERS, "kraken")
class KrakenSegmenter:
    """Raw boxes of the kraken detector; line_boxes() makes lines of them."""

    def segment_page(self, image: Image) -> list[dict]:
        from kraken import binarization, pageseg
        from PIL import Image as Pillow

        with Pillow.open(image_file(image)) as page:
            width, height = page.size
            found = pageseg.segment(binarization.nlbin(page.convert("L")))
        return [{"x1": b[0], "y1": b[1], "x2": b[2], "y2": b[3], "width": width, "height": height} for b in (line.bbox for line in found.lines)]


@register(SEGMENTERS, "doctr")
class DoctrSegmenter:
    """Word boxes of the docTR detector; line_boxes() makes lines of them."""

    def __init__(self):
        from doctr.models import detection_predictor

        self.model = detection_predictor(pretrained=True)

    def segment_page(self, image: Image) -> list[dict]:
        from doctr.io import DocumentFile

        page = DocumentFile.from_images(image if isinstance(image, bytes) else image_file(image))[0]
        h, w = page.shape[:2]
        found = self.model([page])[0]
        boxes = next(iter(found.values())) if isinstance(found, dict) else found
        return [{"x1": int(b[0] * w), "y1": int(b[1] * h), "x2": int(b[2] * w), "y2": int(b[3] * h), "width": w, "height": h, "confidence": float(b[4])} for b in boxes]


#: How a segmenter's raw boxes become lines: by operators.layout.merge_lines, merge_same_line, or not at all.
MERGES = {"kraken": "adaptive", "doctr": "same_line"}
CUTTERS: dict[str, Callable[..., Callable[[str, list[tuple[tuple[int, int, int, int], str]]], None]]] = {}


@register(CUTTERS, "pillow")
def pillow_cutter():
    """Cuts boxes out of a page into PNG files, each written beside its place and moved there."""
    import os

    from PIL import Image as Pillow

    def cut(image: str, jobs: list[tuple[tuple[int, int, int, int], str]]) -> None:
        with Pillow.open(image_file(image)) as page:
            for box, path in jobs:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                page.crop(box).save(f"{path}.part", format="PNG")
                os.replace(f"{path}.part", path)

    return cut


class TrocrRecognizer:
    model_id = "microsoft/trocr-base-handwritten"

    def __init__(self, model_id: str | None = None, batch_size: int = 4, num_beams: int = 1, max_new_tokens: int = 128):
        import torch
        from transformers import TrOCRProcessor, VisionEncoderDecoderModel

        model_id = model_id or self.model_id
        self.torch, self.batch_size, self.options = torch, batch_size, {"num_beams": num_beams, "max_new_tokens": max_new_tokens}
        self.processor, self.model = TrOCRProcessor.from_pretrained(model_id), VisionEncoderDecoderModel.from_pretrained(model_id)

    def recognize_lines(self, crops: list[Image]) -> list[str]:
        from PIL import Image as Pillow

        out: list[str] = []
        for part in chunks(crops, self.batch_size):
            pixels = self.processor(images=[Pillow.open(image_file(p)).convert("RGB") for p in part], return_tensors="pt").pixel_values
            with self.torch.inference_mode():
                out += self.processor.batch_decode(self.model.generate(pixels, **self.options), skip_special_tokens=True)
        return out


@register(RECOGNIZERS, "trocr_handwritten")
class HandwrittenTrocr(TrocrRecognizer):
    pass


@register(RECOGNIZERS, "trocr_printed")
class PrintedTrocr(TrocrRecognizer):
    model_id = "microsoft/trocr-base-printed"


#: Prompt of the transcriber of whole pages: fixed value.
PAGE_PROMPT = "Transcribe this handwritten page to plain text. Output ONLY the transcription. Preserve line breaks. No extra words."


def transcribe_pages(df: DataFrame, settings: ModelSettings, backend: str | None = None, factory: Callable[[ModelSettings], Backend] | None = None, contents: DataFrame | None = None) -> DataFrame:
    """Documents (id, images) to (id, prediction, error): each page image by one call, page texts in order, joined by LF and stripped.

    contents: of sources.corpus.image_contents(); models then get bytes in place of paths.

    A document without images has an empty text; it fails as a whole if one of its calls does.
    """
    from quirefold.functions import text as X
    from quirefold.sources.corpus import with_contents

    pages = df.select("id", F.posexplode("images").alias("page", "image")).select("id", "page", F.lit(PAGE_PROMPT).alias("prompt"), F.array("image").alias("images"))
    if contents is not None:
        pages = with_contents(pages, ["id", "page"], "images", contents, "contents").drop("images").withColumnRenamed("contents", "images")
    calls = generate(pages, settings, images="images", backend=backend, factory=factory)
    ordered = F.sort_array(F.collect_list(F.struct("page", "value", "error")))
    docs = calls.groupBy("id").agg(ordered.alias("p"))
    errors = F.filter(F.transform("p", lambda x: x["error"]), lambda e: e.isNotNull())
    text = X.strip(F.array_join(F.transform("p", lambda x: x["value"]), "\n"))
    found = docs.select("id", F.when(F.size(errors) == 0, text).alias("prediction"), F.when(F.size(errors) > 0, F.array_join(errors, "; ")).alias("error"))
    rest = df.where(F.coalesce(F.size("images"), F.lit(0)) <= 0)
    return found.unionByName(rest.select("id", F.lit("").alias("prediction"), F.lit(None).cast("string").alias("error")))


@register(RECOGNIZERS, "tesseract")
class TesseractRecognizer:
    def recognize_lines(self, crops: list[Image]) -> list[str]:
        import pytesseract
        from PIL import Image as Pillow

        return [pytesseract.image_to_string(Pillow.open(image_file(p))) for p in crops]


@register(RECOGNIZERS, "htr_best_practices_iam")
class UnavailableRecognizer:
    """A name that is reserved; nothing stands behind it."""

    def recognize_lines(self, crops: list[Image]) -> list[str]:
        raise NotImplementedError("this recognizer has no model")


def chunks(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


#: Calls a minute that a provider takes, where options["requests_per_minute"] says nothing else: fixed value.
PER_MINUTE = {"gemini": 25}


class Throttle:
    """At most so many calls a minute, shared evenly by `tasks` tasks; the first calls of the tasks are a gap apart, too."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, tasks: int = 1, task: int = 0):
        self.gap, self.clock, self.sleep = tasks * 60.0 / per_minute, clock, sleep
        self.last = clock() - self.gap + task * 60.0 / per_minute if task else None

    def wait(self) -> None:
        if self.last is not None and (rest := self.last + self.gap - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()




def with_retries(call: Callable[[], str], retries: int = 10, delay: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Doubling delays after rate limits (429) and server failures (5xx); a spent daily quota raises QuotaExhausted at once."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            text = str(e)
            code = getattr(e, "code", None) or getattr(e, "status_code", None)
            limited = code == 429 or "429" in text
            if limited and any(s.lower() in text.lower() for s in DAILY_SIGNS):
                raise QuotaExhausted(text) from e
            passing = isinstance(e, Transient) or limited or (isinstance(code, int) and 500 <= code < 600)
            if not passing or attempt == retries:
                raise
            sleep(delay * 2**attempt)
    raise AssertionError("unreachable")


def generate(df: DataFrame, settings: ModelSettings, prompt: str = "prompt", images: str | None = None, backend: str | None = None, factory: Callable[[ModelSettings], Backend] | None = None) -> DataFrame:
    """df with `value` and `error` per row; one backend per task, by name or by a factory. Failures stay in their row; after a spent quota no more calls are made.

    settings.options["requests_per_minute"] holds over all tasks: rows are dealt to options["tasks"] (1) partitions, of which each takes its share.
    A backend with a `limit` waits by itself, before each attempt.
    """
    name = backend or settings.provider
    rate, tasks = settings.options.get("requests_per_minute", PER_MINUTE.get(name)), int(settings.options.get("tasks", 1))
    df = df.repartition(tasks) if rate else df
    plain = df.withColumns({"value": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, spent = factory(settings) if factory else make(BACKENDS, name, settings), None
        limit = Throttle(rate, tasks=tasks, task=TaskContext.get().partitionId() % tasks) if rate else None
        if limit is not None and hasattr(model, "limit"):
            model.limit, limit = limit, None
        for batch in batches:
            values, errors = [], []
            shown = batch[images] if images else [None] * len(batch)
            for p, i in zip(batch[prompt], shown, strict=True):
                if spent is not None:
                    values.append(None)
                    errors.append(spent)
                    continue
                try:
                    if limit is not None:
                        limit.wait()
                    values.append(model.generate(p, None if i is None else list(i)))
                    errors.append(None)
                except QuotaExhausted as e:
                    spent = f"{QuotaExhausted.SIGN}{e}"
                    values.append(None)
                    errors.append(spent)
                except Exception as e:
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(value=values, error=errors)

    return df.mapInPandas(run, plain.schema)


def raise_if_spent(done: DataFrame) -> None:
    """Raises QuotaExhausted if a row of committed results (error) was stopped by a quota. A main program exits with EXIT_CODE then."""
    stopped = done.where(F.col("error").contains(QuotaExhausted.SIGN)).select("error").head(1)
    if stopped:
        raise QuotaExhausted(stopped[0]["error"])


RAW_BOX = "path string, pos int, x1 int, y1 int, x2 int, y2 int, width int, height int, confidence double"


def segment(pages: DataFrame, segmenter: str, **settings) -> DataFrame:
    """Pages (id, page, image and, if there, content) to raw boxes (id, page, image, path, pos, x1, y1, x2, y2, width, height, confidence).

    The segmenter is a table function that the pages are laterally joined with; it gets the content where there is a column of that name, else
    the path, and is made once a task. A page without boxes, image or content gives no rows.
    """
    names = [c.split()[0] for c in RAW_BOX.split(", ")]

    class Boxes:
        def __init__(self):
            self.model = None

        def eval(self, image):
            if image is None:
                return
            if self.model is None:
                self.model = make(SEGMENTERS, segmenter, **settings)
            for pos, box in enumerate(self.model.segment_page(bytes(image) if isinstance(image, bytearray) else image)):
                row = {"pos": pos, "path": image if isinstance(image, str) else None, **box}
                yield tuple(row.get(k) for k in names)

    shown = "content" if "content" in pages.columns else "image"
    found = pages.select(*dict.fromkeys(["id", "page", "image", shown])).lateralJoin(F.udtf(Boxes, returnType=RAW_BOX)(F.col(shown).outer()))
    return found.select("id", "page", "image", *names)


def line_boxes(raw: DataFrame, merge: str | None, padding: int = 0, **thresholds) -> DataFrame:
    """Raw boxes of segment() to numbered line boxes (id, page, image, line_index, x1, y1, x2, y2), by (y1, x1), padded within the image where the segmenter told its size, else within its left and top."""
    from quirefold.functions import geometry as G
    from quirefold.operators import layout

    box = F.struct("y1", "x1", "pos", "x2", "y2")
    pages = raw.where("x1 is not null").groupBy("id", "page", "image").agg(F.collect_list(box).alias("boxes"), F.max("width").alias("width"), F.max("height").alias("height"))
    if merge == "adaptive":
        pages = layout.merge_lines(pages, "boxes", "lines", **thresholds)
    elif merge == "same_line":
        pages = pages.withColumn("lines", layout.merge_same_line(F.col("boxes"), F.col("height"), **thresholds))
    elif merge is None:
        pages = pages.withColumn("lines", F.transform("boxes", lambda b: G.box(b["x1"], b["y1"], b["x2"], b["y2"])))
    else:
        raise ValueError(f"unknown merge {merge!r}")
    each = layout.explode_made(pages, ["id", "page", "image", "width", "height"], F.col("lines"), "at", "b").select("id", "page", "image", "width", "height", "b.*")
    numbered = layout.number_lines(each.withColumn("_page", F.struct("id", "page")), "_page")
    padded = G.pad(F.struct("x1", "y1", "x2", "y2"), padding, F.col("width"), F.col("height"))
    return numbered.select("id", "page", "image", "line_index", padded.alias("b")).select("id", "page", "image", "line_index", "b.*")


def cut_lines(lines: DataFrame, cache_root: str, cutter: str = "pillow") -> DataFrame:
    """Line boxes with `path`, each cut to <cache_root>/<id>/<page stem>/<page stem>_lineNNN.png, in a folder that all executors mount."""
    from quirefold.functions.naming import crop_name, stem

    schema = "id string, page int, image string, line_index int, x1 int, y1 int, x2 int, y2 int, path string"
    path = F.concat_ws("/", F.lit(cache_root.rstrip("/")), "id", stem(F.col("image")), crop_name(stem(F.col("image")), F.col("line_index")))
    named = lines.withColumn("path", path).select(*[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = make(CUTTERS, cutter)
        for batch in batches:
            for image, rows in batch.groupby("image", sort=False):
                cut(image, [((int(r.x1), int(r.y1), int(r.x2), int(r.y2)), r.path) for r in rows.itertuples()])
            yield batch

    return named.mapInPandas(run, schema)


def cut_contents(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Line boxes with `path` (null) and `content`: each cut out of the page's content (id, page, content) as a PNG; a page is decoded once."""
    boxes = lines.groupBy("id", "page").agg(F.sort_array(F.collect_list(F.struct("line_index", "x1", "y1", "x2", "y2"))).alias("boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, p, found, content in zip(*[batch[c] for c in ("id", "page", "boxes", "content")], strict=True):
                page = images.pixels(content.as_py())
                for b in found.as_py():
                    cut = images.png(images.crop(page, (b["x1"], b["y1"], b["x2"], b["y2"])))
                    yield pa.RecordBatch.from_pylist([{"id": i.as_py(), "page": p.as_py(), "line_index": b["line_index"], "path": None, "content": cut}], schema)

    schema = pa.schema([("id", pa.string()), ("page", pa.int32()), ("line_index", pa.int32()), ("path", pa.string()), ("content", pa.binary())])
    held = pages.where("content is not null").select("id", "page", "content").join(boxes, ["id", "page"])
    return held.select("id", "page", "boxes", "content").mapInArrow(run, "id string, page int, line_index int, path string, content binary")


def recognize(crops: DataFrame, recognizer: str, **settings) -> DataFrame:
    """Crops (id, page, line_index, path and, if there, content) with `text`; a batch is one call. Contents are shown where there is such a column, else paths."""
    schema = "id string, page int, line_index int, path string, text string"
    shown = "content" if "content" in crops.columns else "path"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make(RECOGNIZERS, recognizer, **settings)
        for batch in batches:
            yield batch.assign(text=model.recognize_lines(batch[shown].tolist()))[["id", "page", "line_index", "path", "text"]]

    return crops.select("id", "page", "line_index", "path", *(["content"] if shown == "content" else [])).mapInPandas(run, schema)


def recognize_documents(
    pages: DataFrame,
    segmenter: str,
    recognizer: str,
    max_pages: int | None = None,
    cache_root: str | None = None,
    crops: DataFrame | None = None,
    done: DataFrame | None = None,
    cutter: str = "pillow",
    merge: str | None = "",
    padding: int = 0,
    settings: dict | None = None,
) -> DataFrame:
    """Pages (id, page, image) to documents (id, ocr, num_pages, num_lines): segment, merge to lines, cut, recognise, assemble in order.

    Pages of sources.corpus.page_contents() go through as bytes: nothing is opened by path, and no files are cut.

    crops: existing crops of sources.corpus.line_crops (page, crops), which the passthrough segmenter takes in place of the page.
    done: ids that have a result already and are left out. Other segmenters cut their lines into files below cache_root.
    merge: "adaptive", "same_line", None for raw boxes, "" for what the segmenter needs. settings: of the recognizer.
    """
    from quirefold.operators.layout import assemble
    from quirefold.sources.corpus import crops_or_page

    pages, held = planned_pages(pages, max_pages, done), "content" in pages.columns
    if segmenter == "passthrough":
        if held and crops is None:
            found = pages.where("content is not null").select("id", "page", F.lit(0).alias("line_index"), F.col("image").alias("path"), "content")
        elif crops is not None:
            found = crops_or_page(pages.withColumnRenamed("page", "number"), crops).select("id", F.col("number").alias("page"), F.posexplode("crops").alias("line_index", "path"))
        else:
            found = pages.select("id", "page", F.lit(0).alias("line_index"), F.col("image").alias("path"))
    elif held:
        found = cut_contents(line_boxes(segment(pages, segmenter), MERGES.get(segmenter) if merge == "" else merge, padding), pages)
    else:
        if cache_root is None:
            raise ValueError("cache_root must name a folder for the cut lines")
        found = cut_lines(line_boxes(segment(pages, segmenter), MERGES.get(segmenter) if merge == "" else merge, padding), cache_root, cutter)
    read = recognize(found, recognizer, **settings or {})
    lines = pages.select("id", "page").join(read.select("id", "page", "line_index", "text"), ["id", "page"], "left")
    return assemble(lines)


def planned_pages(pages: DataFrame, max_pages: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """The pages that recognize_documents() would read."""
    if max_pages is not None:
        pages = pages.where(F.col("page") < max_pages)
    return pages if done is None else pages.join(done.select("id").distinct(), "id", "left_anti")


def dry_run(pages: DataFrame, max_pages: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """(id, num_pages) of the documents that would be recognised; nothing is read, called or written."""
    return planned_pages(pages, max_pages, done).groupBy("id").agg(F.count(F.lit(1)).alias("num_pages"))
