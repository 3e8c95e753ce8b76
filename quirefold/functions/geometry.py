"""Boxes {x1, y1, x2, y2} in pixels: overlap, gap, union, padding, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height by the smaller height; 0 for disjoint or flat boxes."""
    shared = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    least = F.least(height(a), height(b))
    return F.when((shared <= 0) | (least <= 0), F.lit(0.0)).otherwise(shared / least)


def vertical_gap(a: Column, b: Column) -> Column:
    """Distance between the boxes' rows; -1 where they overlap."""
    return F.when(a["y2"] <= b["y1"], b["y1"] - a["y2"]).when(b["y2"] <= a["y1"], a["y1"] - b["y2"]).otherwise(F.lit(-1))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def union_all(boxes: Column) -> Column:
    """Least box around an array of boxes; null for none."""
    side = lambda k, f: f(F.transform(boxes, lambda b: b[k]))
    return F.when(F.size(boxes) > 0, box(side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max)))


def pad(b: Column, by: int, width: Column | None = None, height_: Column | None = None) -> Column:
    """Box grown on all sides, not below 0 and, where the image's size is given, not beyond it."""
    x2, y2 = b["x2"] + by, b["y2"] + by
    return box(F.greatest(b["x1"] - by, F.lit(0)), F.greatest(b["y1"] - by, F.lit(0)), x2 if width is None else F.least(x2, width), y2 if height_ is None else F.least(y2, height_))


def from_relative(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height_: Column) -> Column:
    """Pixels of coordinates given in shares of the image, cut to whole numbers."""
    return box(x1 * width, y1 * height_, x2 * width, y2 * height_)


def printed_part(handwritten: Column, form_width: Column, header: int = 300, margin: int = 20, no_width: int = 2479, no_handwriting: int = 700) -> Column:
    """Where the printed text of a form lies: under its header, above the handwriting. The numbers are fixed values."""
    return box(F.lit(0), F.lit(header), F.coalesce(form_width, F.lit(no_width)), F.coalesce(handwritten["y1"] - margin, F.lit(no_handwriting)))


def scaled_size(width: Column, height_: Column, longest: int = 1280) -> Column:
    """Size after shrinking the longer side to `longest`, cut to whole numbers; smaller images stay."""
    most = F.greatest(width, height_)
    scale = F.lit(float(longest)) / most
    fits = most <= longest
    return F.struct(F.when(fits, width).otherwise((width * scale).cast("int")).alias("width"), F.when(fits, height_).otherwise((height_ * scale).cast("int")).alias("height"))


def outline_box(outline: Column) -> Column:
    """Least box around an array of points {x, y}; null for none."""
    side = lambda k, f: f(F.transform(outline, lambda p: p[k]))
    return F.when(F.size(outline) > 0, box(side("x", F.array_min), side("y", F.array_min), side("x", F.array_max), side("y", F.array_max)))


def detected_box(*shapes: Column) -> Column:
    """Box of the first shape (boundary, box, polygon, baseline, ...) that a detector gave."""
    return F.coalesce(*[outline_box(s) for s in shapes])


def upper_order_statistic(values: Column, numerator: int = 1, denominator: int = 2) -> Column:
    """Element number size * numerator // denominator of the sorted values, from 0."""
    return F.get(F.sort_array(values), F.floor(F.size(values) * numerator / denominator).cast("int"))
