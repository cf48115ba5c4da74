"""Masks as columns: the pixels of an image that belong to something, as runs.

A mask is an array of struct(start, length): runs of pixels counted along the rows of an image of a known width, sorted,
apart from each other. Everything is a fold over such arrays; no pixel is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<start:int,length:int>>"
NONE = f"cast(array() as {TYPE})"


def run(start: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))


def of_flags(flags: Column) -> Column:
    """The mask of an array of booleans, one a pixel; null counts as false."""
    on = lambda k: F.coalesce(F.get(flags, k), F.lit(False))
    places = F.when(F.size(flags) > 0, F.sequence(F.lit(0), F.size(flags) - 1)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(places, lambda k: on(k) & ~F.when(k > 0, on(k - 1)).otherwise(F.lit(False)))
    lasts = F.filter(places, lambda k: on(k) & ~on(k + 1))
    return F.zip_with(firsts, lasts, lambda a, z: run(a, z - a + 1))


def of_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column) -> Column:
    """The mask of whole pixels from (x1, y1) up to, without, (x2, y2), inside the image's width."""
    left, right = F.greatest(x1, F.lit(0)), F.least(x2, width)
    rows = F.sequence(F.greatest(y1, F.lit(0)), y2 - 1)
    whole = F.array(run(F.greatest(y1, F.lit(0)) * width, (y2 - F.greatest(y1, F.lit(0))) * width))
    some = F.when((left == 0) & (right == width), whole).otherwise(F.transform(rows, lambda y: run(y * width + left, right - left)))
    return F.when((right > left) & (y2 > F.greatest(y1, F.lit(0))), some).otherwise(F.expr(NONE))


def area(mask: Column) -> Column:
    """Pixels of a mask."""
    return F.aggregate(mask, F.lit(0).cast("long"), lambda n, r: n + r["length"])


def share(mask: Column, width: Column, height: Column) -> Column:
    """The part of an image's pixels that a mask has."""
    return area(mask) / (width * height)


def bounds(mask: Column, width: Column) -> Column:
    """struct(x1, y1, x2, y2) of a mask's pixels, the second corner without; null for an empty mask."""
    first, last = lambda r: r["start"], lambda r: r["start"] + r["length"] - 1
    row = lambda k: F.floor(k / width).cast("int")
    wraps = lambda r: row(first(r)) < row(last(r))
    x1 = F.array_min(F.transform(mask, lambda r: F.when(wraps(r), 0).otherwise(first(r) % width)))
    x2 = F.array_max(F.transform(mask, lambda r: F.when(wraps(r), width).otherwise(last(r) % width + 1)))
    y1, y2 = F.array_min(F.transform(mask, lambda r: row(first(r)))), F.array_max(F.transform(mask, lambda r: row(last(r)) + 1))
    box = F.struct(x1.cast("int").alias("x1"), y1.alias("y1"), x2.cast("int").alias("x2"), y2.alias("y2"))
    return F.when(F.size(mask) > 0, box)


def _swept(a: Column, b: Column, depth: int) -> Column:
    """Runs of the pixels that at least `depth` of the two masks have: one pass over their sorted edges."""
    edges = lambda m: F.flatten(F.transform(m, lambda r: F.array(F.struct(r["start"].alias("at"), F.lit(1).alias("by")), F.struct((r["start"] + r["length"]).alias("at"), F.lit(-1).alias("by")))))
    both = F.array_sort(F.concat(edges(a), edges(b)))  # at one place ends come before starts
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("since"), F.expr(NONE).alias("runs"))

    def step(s: Column, e: Column) -> Column:
        now = s["depth"] + e["by"]
        closes = (s["depth"] >= depth) & (now < depth) & (e["at"] > s["since"])
        last = F.element_at(s["runs"], -1)
        goes_on = (F.size(s["runs"]) > 0) & (F.try_element_at(s["runs"], F.lit(-1))["start"] + F.try_element_at(s["runs"], F.lit(-1))["length"] == s["since"])
        longer = F.concat(F.slice(s["runs"], F.lit(1), F.size(s["runs"]) - 1), F.array(run(last["start"], e["at"] - last["start"])))
        added = F.when(goes_on, longer).otherwise(F.concat(s["runs"], F.array(run(s["since"], e["at"] - s["since"]))))
        opens = (s["depth"] < depth) & (now >= depth)
        return F.struct(now.alias("depth"), F.when(opens, e["at"]).otherwise(s["since"]).alias("since"), F.when(closes, added).otherwise(s["runs"]).alias("runs"))

    return F.aggregate(both, start, step, lambda s: s["runs"])


def both(a: Column, b: Column) -> Column:
    """The pixels that both masks have."""
    return _swept(a, b, 2)


def either(a: Column, b: Column) -> Column:
    """The pixels that one of the masks has, or both."""
    return _swept(a, b, 1)


def without(mask: Column, pixels: Column) -> Column:
    """The other pixels of an image of so many."""
    whole = F.array(run(F.lit(0), pixels))
    ends = F.concat(F.array(F.lit(0)), F.transform(mask, lambda r: r["start"] + r["length"]))
    starts = F.concat(F.transform(mask, lambda r: r["start"]), F.array(pixels.cast("int")))
    gaps = F.filter(F.zip_with(ends, starts, lambda a, z: run(a, z - a)), lambda r: r["length"] > 0)
    return F.when(F.size(mask) == 0, whole).otherwise(gaps)


def iou(a: Column, b: Column) -> Column:
    """Shared pixels over all pixels of two masks; 0 if both are empty."""
    shared = area(both(a, b))
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(0.0)


def best(masks: Column, scores: Column) -> Column:
    """Of an array of masks the one of the highest score, the first of equal ones; null if there is none."""
    return F.get(masks, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def center(width: Column, height: Column, ratio: float) -> Column:
    """The middle of an image, a rectangle of `ratio` of its sides."""
    w, h = F.greatest(F.lit(1), F.floor(width * ratio)).cast("int"), F.greatest(F.lit(1), F.floor(height * ratio)).cast("int")
    x, y = F.floor((width - w) / 2).cast("int"), F.floor((height - h) / 2).cast("int")
    return of_box(x, y, x + w, y + h, width)


def plausible(mask: Column, width: Column, height: Column, low: float, high: float, ratio: float) -> Column:
    """mask, if its share of the image is from low to high, else the image's middle."""
    part = share(mask, width, height)
    return F.when(part.between(low, high), mask).otherwise(center(width, height, ratio))
