"""Boxes as four flat columns in absolute xyxy pixels; every function builds Columns, so all of it is code-generated."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDS = ("x1", "y1", "x2", "y2")
FORMATS = ("xyxy", "xywh", "cxcywh")
PATCH = 14


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, COORDS)]

    def map(self, f) -> Box:
        return Box(*map(f, self))


def box(prefix: str = "", of: Column | None = None) -> Box:
    """The box in columns <prefix>x1 ...; of: in the fields of a struct."""
    return Box(*[(F.col(prefix + n) if of is None else of[prefix + n]) for n in COORDS])


def area(b: Box) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0.0)) * F.greatest(b.y2 - b.y1, F.lit(0.0))


def clip(b: Box, width: Column, height: Column) -> Box:
    """The box inside an image; a box outside it becomes empty on the border."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    return Box(inside(b.x1, width), inside(b.y1, height), inside(b.x2, width), inside(b.y2, height))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; boxes that only touch, or are empty, have 0."""
    common = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0)) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    union = area(a) + area(b) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(F.lit(0.0))


def convert(b: Box, src: str, dst: str, width: Column, height: Column, normalized_in: bool = False, normalized_out: bool = False) -> Box:
    """Between corner, corner-and-size and centre-and-size boxes; normalised ones are fractions of the image."""
    for f in (src, dst):
        if f not in FORMATS:
            raise ValueError(f"box format {f!r} is not one of {FORMATS}")
    sides = (width, height, width, height)
    if normalized_in:
        b = Box(*[v * s for v, s in zip(b, sides)])
    if src == "xywh":
        b = Box(b.x1, b.y1, b.x1 + b.x2, b.y1 + b.y2)
    elif src == "cxcywh":
        b = Box(b.x1 - b.x2 / 2, b.y1 - b.y2 / 2, b.x1 + b.x2 / 2, b.y1 + b.y2 / 2)
    if dst == "xywh":
        b = Box(b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1)
    elif dst == "cxcywh":
        b = Box((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1)
    if normalized_out:
        b = Box(*[v / s for v, s in zip(b, sides)])
    return b


def shift(b: Box, dx: Column, dy: Column) -> Box:
    """From a tile's coordinates to the frame's."""
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def rescale(b: Box, scale: Column) -> Box:
    """From a scaled frame's coordinates to the frame's."""
    return b.map(lambda v: v / scale)


def crop_rect(b: Box, width: Column, height: Column, pad: float) -> Box:
    """The padded crop as whole pixels (cut towards zero) inside the image."""
    px, py = (b.x2 - b.x1) * pad, (b.y2 - b.y1) * pad
    low = lambda v: F.greatest(F.lit(0), v.cast("int"))
    high = lambda v, most: F.least(most.cast("int"), v.cast("int"))
    return Box(low(b.x1 - px), low(b.y1 - py), high(b.x2 + px, width), high(b.y2 + py, height))


def center_box(width: Column, height: Column, ratio: float) -> Box:
    """The centred rectangle of a share of each side, rounded half to even."""
    w, h = F.bround(width * ratio, 0).cast("int"), F.bround(height * ratio, 0).cast("int")
    x, y = F.floor((width - w) / 2).cast("int"), F.floor((height - h) / 2).cast("int")
    return Box(x, y, x + w, y + h)


def rounded(b: Box) -> Box:
    """Whole pixels, half to even."""
    return b.map(lambda v: F.bround(v, 0).cast("int"))


def from_patches(gx1: Column, gy1: Column, gx2: Column, gy2: Column, scale_x: Column, scale_y: Column, dx: Column, dy: Column, patch: int = PATCH) -> Box:
    """Pixels of a range of grid cells, last ones included."""
    return Box(gx1 * patch * scale_x + dx, gy1 * patch * scale_y + dy, (gx2 + 1) * patch * scale_x + dx, (gy2 + 1) * patch * scale_y + dy)
