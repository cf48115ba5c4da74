"""Tiles, scales and keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiles(width: Column, height: Column, tile: tuple[int, int], overlap: float) -> Column:
    """array of struct(tile_id, tx1, ty1, tx2, ty2): tiles that cover an image, row by row.

    Neighbours overlap by a share of a side; the last tile of a row or column is moved back inside the image.
    """

    def starts(side: Column, t: int) -> Column:
        stride = max(1, int(t * (1 - overlap)))
        most = F.greatest(side - t, F.lit(0))
        steps = F.ceil(most / stride).cast("int")
        return F.array_distinct(F.transform(F.sequence(F.lit(0), steps), lambda i: F.least(i * stride, most).cast("int")))

    xs, ys = starts(width, tile[0]), starts(height, tile[1])
    rect = lambda x, y: F.struct(x.alias("tx1"), y.alias("ty1"), F.least(x + tile[0], width).cast("int").alias("tx2"), F.least(y + tile[1], height).cast("int").alias("ty2"))
    all_ = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: rect(x, y))))
    return F.transform(all_, lambda r, i: F.struct(i.alias("tile_id"), r["tx1"].alias("tx1"), r["ty1"].alias("ty1"), r["tx2"].alias("tx2"), r["ty2"].alias("ty2")))


def tile_frames(frames: DataFrame, tile: tuple[int, int] = (640, 640), overlap: float = 0.25) -> DataFrame:
    """Each frame with each of its tiles; a generator, so nothing is shuffled."""
    return frames.select("*", F.inline(tiles(F.col("width"), F.col("height"), tile, overlap)))


def scale_frames(frames: DataFrame, scales: list[float]) -> DataFrame:
    return frames.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))


def keyframes(frames: DataFrame, interval: int) -> DataFrame:
    """Every interval-th frame from 0; none if interval is 0 or less."""
    return frames.where(F.lit(interval > 0) & (F.col("frame") % max(interval, 1) == 0))


def keyframe_sequence(total: Column, interval: int) -> Column:
    none = F.array().cast("array<int>")
    return none if interval <= 0 else F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"), F.lit(interval))).otherwise(none)


def timeline(df: DataFrame, total: Column, widest: int = 2000) -> DataFrame:
    """Occupied cells of a strip of at most `widest` cells: floor(frame * cells / total)."""
    cells = F.least(total, F.lit(widest))
    return df.select("video_id", F.floor(F.col("frame") * cells / total).cast("int").alias("cell")).distinct()
