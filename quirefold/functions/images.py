"""Page images as PNG bytes: decoded by Spark's image source, made RGB, shrunk and encoded in Arrow batches; no image library is needed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
PREPARED = "path string, width int, height int, content binary"


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of rows x columns x 3; rows are stored as differences to the row above."""
    h, w = pixels.shape[:2]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(h, 3 * w)
    rows = np.concatenate([rows[:1], rows[1:] - rows[:-1]])
    kinds = np.full((h, 1), 2, np.uint8)
    kinds[0] = 0

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(np.hstack([kinds, rows]).tobytes(), 6)) + chunk(b"IEND", b"")


def pixels(content: bytes) -> np.ndarray:
    """Rows x columns x 3 of a PNG as png() writes it."""
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG; sources.corpus.image_contents() prepares images")
    at, body = len(SIGNATURE), b""
    while at < len(content):
        (size,), name = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        if name == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", content[at + 8 : at + 21])
        elif name == b"IDAT":
            body += content[at + 8 : at + 8 + size]
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    raw = raw.reshape(h, -1)
    if (depth, colour, interlaced) != (8, 2, 0) or (raw[:, 0] != np.minimum(np.arange(h), 1) * 2).any():
        raise ValueError("a PNG of another kind; sources.corpus.image_contents() prepares images")
    return np.cumsum(raw[:, 1:], axis=0, dtype=np.uint8).reshape(h, w, 3)


def size_within(width: int, height: int, longest: int) -> tuple[int, int]:
    """Size after shrinking the longer side to `longest`, cut to whole numbers, 1 at least; smaller images stay."""
    side = max(width, height)
    return (width, height) if side <= longest else (max(1, int(width * longest / side)), max(1, int(height * longest / side)))


def shrink(image: np.ndarray, longest: int = 1280) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers."""
    w, h = size_within(image.shape[1], image.shape[0], longest)
    if (h, w) == image.shape[:2]:
        return image

    def along(values: np.ndarray, n: int) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
        at = np.linspace(0, len(values), n + 1)
        low = np.minimum(at.astype(np.int64), len(values) - 1)
        part = (at - low).reshape(-1, *[1] * (values.ndim - 1))
        edges = sums[low] + part * (sums[low + 1] - sums[low])
        return np.diff(edges, axis=0) * (n / len(values))

    small = along(along(image, h).swapaxes(0, 1), w).swapaxes(0, 1)
    return np.clip(np.rint(small), 0, 255).astype(np.uint8)


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows x columns x 3 of the image source's bytes (grey, BGR or BGRA; what is transparent shows its colour)."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def crop(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The part in a box (x1, y1, x2, y2); what lies beyond the image is black, as image libraries have it."""
    x1, y1, x2, y2 = box
    out = np.zeros((max(1, y2 - y1), max(1, x2 - x1), 3), np.uint8)
    left, top, right, bottom = max(x1, 0), max(y1, 0), min(x2, image.shape[1]), min(y2, image.shape[0])
    if right > left and bottom > top:
        out[top - y1 : bottom - y1, left - x1 : right - x1] = image[top:bottom, left:right]
    return out


def prepared(images: DataFrame, longest: int = 1280) -> DataFrame:
    """PREPARED of images (path, height, width, nChannels, data) as Spark's image source gives them: RGB PNG with no side over `longest`.

    An image that cannot be decoded has a null content and no size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, h, w, channels, data in zip(*[batch[c] for c in ("path", "height", "width", "nChannels", "data")], strict=True):
                out = [None, None, None]
                if (h.as_py() or 0) > 0:
                    small = shrink(rgb(data.as_py(), h.as_py(), w.as_py(), channels.as_py()), longest)
                    out = [small.shape[1], small.shape[0], png(small)]
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "width", "height", "content"), [path.as_py(), *out], strict=True))], schema)

    schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary())])
    return images.select("path", "height", "width", "nChannels", "data").mapInArrow(run, PREPARED)
