"""Tubes: smoothing, gap filling, segments, and the whole last stage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.box import COORDS

#: Frames a block: what one task holds of a video. Blocks of a video meet in one row each.
BLOCK = 65_536
KEYS = ["video_id", "_block"]


def in_block():
    return Window.partitionBy(*KEYS).orderBy("frame")


def over_blocks():
    return Window.partitionBy("video_id").orderBy("_block")


def blocked(tube: DataFrame, block: int) -> DataFrame:
    """tube with _block, the number of its frame's block. A video's frames are distinct."""
    if block < 1:
        raise ValueError("block must be at least 1")
    return tube.withColumn("_block", F.floor(F.col("frame") / block))


def ema(tube: DataFrame, alpha: float = 0.6, block: int = BLOCK) -> DataFrame:
    """s_0 = b_0, s_t = alpha b_t + (1 - alpha) s_(t-1) over a video's present frames; gaps don't reset it.

    A scan in three steps, so that one long video fills all tasks. Each block is folded as if it were the first (r_i, from
    its first box b). Its last row's r, with the box and the number of rows, is the affine map of the block; these, a row
    a block, are composed in order. A row i of a block that begins with s is then r_i + (1 - alpha)^(i + 1) (s - b).
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    kept, tube = tube.columns, blocked(tube, block)
    names = tube.columns
    who, where, sides = names.index("video_id"), names.index("_block"), [names.index(c) for c in COORDS]
    firsts, ends = [f"_b_{c}" for c in COORDS], [f"_r_{c}" for c in COORDS]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, first, done = None, None, None, 0
        for b in batches:
            keys = list(zip(b.column(who).to_pylist(), b.column(where).to_pylist()))
            boxes = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in sides], axis=1)
            begun, place = np.empty_like(boxes), np.empty(len(keys), dtype=np.int64)
            starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
            for at, stop in zip(starts, [*starts[1:], len(keys)]):
                if keys[at] != key:
                    key, last, first, done = keys[at], boxes[at : at + 1].copy(), boxes[at].copy(), 0
                path = pd.DataFrame(np.concatenate([last, boxes[at:stop]])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
                boxes[at:stop], begun[at:stop], place[at:stop] = path, first, np.arange(done, done + stop - at)
                last, done = path[-1:], done + stop - at
            columns = list(b.columns)
            for k, i in enumerate(sides):
                columns[i] = pa.array(boxes[:, k])
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(begun[:, k]) for k in range(4)], pa.array(place)], names=[*names, *firsts, "_i"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = None, None
        for b in batches:
            videos, n = b.column(0).to_pylist(), b.column(2).to_numpy()
            first, end = (np.stack([b.column(k + j).to_numpy() for j in range(4)], axis=1) for k in (3, 7))
            shift = np.zeros_like(first)
            for i, v in enumerate(videos):
                if i == 0 and video is None or v != video:
                    video, state = v, first[i]
                shift[i] = state - first[i]
                state = end[i] + (1 - alpha) ** float(n[i]) * shift[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(shift[:, k]) for k in range(4)]], names=[*KEYS, *[f"_s_{c}" for c in COORDS]])

    fields = [T.StructField(f.name, T.DoubleType()) if f.name in COORDS else f for f in tube.schema.fields]
    extra = [*[T.StructField(c, T.DoubleType()) for c in firsts], T.StructField("_i", T.LongType())]
    local = tube.repartition(*KEYS).sortWithinPartitions(*KEYS, "frame").mapInArrow(fold, T.StructType(fields + extra))
    last = F.max(F.struct("_i", *firsts, *COORDS)).alias("_last")
    maps = local.groupBy(*KEYS).agg(last).select(*KEYS, (F.col("_last._i") + 1).alias("_n"), *[F.col(f"_last.{c}") for c in firsts], *[F.col(f"_last.{c}").alias(e) for c, e in zip(COORDS, ends)])
    kinds = [tube.schema["video_id"], tube.schema["_block"], *[T.StructField(f"_s_{c}", T.DoubleType()) for c in COORDS]]
    shifts = maps.repartition("video_id").sortWithinPartitions(*KEYS).mapInArrow(compose, T.StructType(kinds))
    moved = lambda c: F.col(c) + F.pow(F.lit(1 - alpha), F.col("_i") + 1) * F.coalesce(f"_s_{c}", F.lit(0.0))
    return local.join(shifts, KEYS, "left").select(*[moved(c).alias(c) if c in COORDS else F.col(c) for c in kept])


def with_halo(tube: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """tube with _block and _own: rows of the `before` frames before a block and the `after` frames after it come to
    the block too, not _own. What looks no further than that needs no join with other blocks."""
    if block < 1:
        raise ValueError("block must be at least 1")
    number = lambda f: F.floor(f / block).cast("long")
    blocks = F.sequence(number(F.col("frame") - after), number(F.col("frame") + before))
    return tube.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == number(F.col("frame")))


def fill_gaps(tube: DataFrame, max_gap: int = 3, block: int = BLOCK) -> DataFrame:
    """(video_id, frame, box, score) with inner gaps of 1 to max_gap frames filled by straight lines; a filled
    frame's score is the mean of its neighbours'. A block sees max_gap + 1 frames more, as far as a gap can reach."""
    steps = with_halo(tube.select("video_id", "frame", *COORDS, "score"), 0, max(max_gap, 0) + 1, block)
    steps = steps.withColumn("_after", F.lead(F.struct("frame", *COORDS, "score")).over(in_block())).where("_own")
    gap = F.col("_after.frame") - F.col("frame") - 1
    steps = steps.withColumn("_gap", F.when(gap.between(1, max_gap), gap).otherwise(0)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_gap").cast("int"))))
    t = F.col("_j") / (F.col("_gap") + 1)
    line = lambda c: F.when(F.col("_j") == 0, F.col(c)).otherwise(F.col(c) + t * (F.col(f"_after.{c}") - F.col(c)))
    score = F.when(F.col("_j") == 0, F.col("score")).otherwise((F.col("score") + F.col("_after.score")) / 2)
    return steps.select("video_id", (F.col("frame") + F.col("_j")).cast("int").alias("frame"), *[line(c).alias(c) for c in COORDS], score.alias("score"))


def segments(tube: DataFrame, block: int = BLOCK) -> DataFrame:
    """tube with segment, the number of its run of consecutive frames, and segment_len.

    Runs are numbered and measured inside blocks; only a block's first and last run can go on in its neighbours, so a row
    a block settles where numbers begin and how long these two are in all.
    """
    runs = blocked(tube, block).withColumn("_island", F.col("frame") - F.row_number().over(in_block()))
    runs = runs.withColumn("_run", F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("_island"))).withColumn("_len", F.count("*").over(Window.partitionBy(*KEYS, "_island")))
    edge = lambda f: f(F.struct("frame", "_len", "_run"))
    blocks = runs.groupBy(*KEYS).agg(edge(F.min).alias("_a"), edge(F.max).alias("_z"))
    goes_on = F.coalesce((F.col("_a.frame") == F.lag("_z.frame").over(over_blocks()) + 1).cast("int"), F.lit(0))
    blocks = blocks.withColumn("_on", goes_on).withColumn("_until", F.sum(F.col("_z._run") - F.col("_on")).over(over_blocks()))
    blocks = blocks.withColumn("_from", F.col("_until") - F.col("_z._run") + 1)
    piece = lambda number, length: F.struct(number.alias("number"), length.alias("length"))
    both = F.array(piece(F.col("_from"), F.col("_a._len")), piece(F.col("_until"), F.col("_z._len")))
    pieces = blocks.select(*KEYS, F.inline(F.array_distinct(both)))
    total = F.sum("length").over(Window.partitionBy("video_id", "number"))
    edges = pieces.withColumn("total", total).groupBy(*KEYS).agg(F.min(F.struct("number", "total")).alias("_a"), F.max(F.struct("number", "total")).alias("_z"))
    number = F.col("_a.number") + F.col("_run") - 1
    length = F.when(number == F.col("_a.number"), F.col("_a.total")).when(number == F.col("_z.number"), F.col("_z.total")).otherwise(F.col("_len"))
    return runs.join(edges, KEYS, "left").select(*tube.columns, length.cast("int").alias("segment_len"), number.cast("int").alias("segment"))


def drop_short(tube: DataFrame, min_length: int = 2, block: int = BLOCK) -> DataFrame:
    """The rows of runs of at least min_length frames. A block sees min_length - 1 frames more on both sides: of a longer
    run that much is there, a shorter one is there whole."""
    far = max(min_length, 1) - 1
    runs = with_halo(tube, far, far, block).withColumn("_island", F.col("frame") - F.row_number().over(in_block()))
    long = runs.withColumn("_len", F.count("*").over(Window.partitionBy(*KEYS, "_island"))).where(F.col("_own") & (F.col("_len") >= min_length))
    return long.select(*tube.columns)


def final_tube(tracks: DataFrame, alpha: float | None = 0.6, max_gap: int = 3, min_length: int = 2) -> DataFrame:
    """Present boxes, smoothed (alpha None: not), gaps filled, short segments dropped, in this order."""
    tube = tracks.where(F.col("x1").isNotNull())
    tube = tube if alpha is None else ema(tube, alpha)
    return drop_short(fill_gaps(tube, max_gap), min_length)
