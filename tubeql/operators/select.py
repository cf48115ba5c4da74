"""Greedy suppression, top-k, caps and first maxima. Ties fall to the smaller id, as in a stable sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.box import COORDS, area, box, iou
from .shared import settle


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int | None) -> DataFrame:
    """The first n rows of each key; all if n is None. Spark keeps n rows a key before the shuffle already."""
    if n is None:
        return df
    w = W.Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def top_k(df: DataFrame, keys: list[str], by: str, n: int | None, tie: str) -> DataFrame:
    return first_rows(df, keys, [F.col(by).desc(), F.col(tie)], n)


def first_max(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """The first maximum of each key, as an aggregate that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    head = F.min(F.struct((-F.col(by)).alias("_by"), F.col(tie).alias("_tie"), *rest)).alias("_head")
    return df.groupBy(*keys).agg(head).select(*keys, *[F.col(f"_head.{c}") for c in rest])


def nms(df: DataFrame, keys: list[str], by: str, threshold: float, tie: str) -> DataFrame:
    """Greedy non-maximum suppression inside each key: a box goes if its IoU with a kept one exceeds threshold.

    A key's boxes are one array (a frame's, so their number is bounded by the model's), folded in order of score.
    _nms_rank counts the kept boxes of a key from 1.
    """
    rest = [c for c in df.columns if c not in keys]
    item = F.struct((-F.col(by)).alias("_by"), F.col(tie).alias("_tie"), *rest)
    fields = T.StructType([T.StructField("_by", T.DoubleType()), T.StructField("_tie", df.schema[tie].dataType), *[T.StructField(c, df.schema[c].dataType) for c in rest]])
    none = F.array().cast(T.ArrayType(fields))
    keep = lambda kept, b: F.when(F.exists(kept, lambda k: iou(box(of=k), box(of=b)) > threshold), kept).otherwise(F.concat(kept, F.array(b)))
    folded = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).cast(T.ArrayType(fields)).alias("_all")).select(*keys, F.aggregate("_all", none, keep).alias("_kept"))
    return folded.select(*keys, F.posexplode("_kept").alias("_i", "_b")).select(*keys, *[F.col(f"_b.{c}") for c in rest], (F.col("_i") + 1).alias("_nms_rank"))


def overlapping_pairs(df: DataFrame, keys: list[str], tie: str, threshold: float) -> DataFrame:
    """Pairs of one key's boxes whose IoU exceeds threshold, which must be above 0."""
    pairs = _met(df, keys, tie, threshold, [])
    first = F.col(tie) < F.col("o_" + tie)
    return pairs.select(*keys, F.when(first, F.col(tie)).otherwise(F.col("o_" + tie)).alias(tie), F.when(first, F.col("o_" + tie)).otherwise(F.col(tie)).alias("other_id"), "iou")


#: Boxes of a block at most. A pair of blocks is one row of the join, and Spark holds what a row is unfolded into.
BLOCK = 128


def _met(df: DataFrame, keys: list[str], tie: str, threshold: float, extra: list[str]) -> DataFrame:
    """Each pair once: (keys, tie, extra and the same with o_, iou), found on grids, so that distant boxes don't meet.

    A box belongs to the grid whose cells are as long as its longer side, rounded up to a power of two, so it touches at
    most four of them. Longer sides of a pair differ by less than 1 / threshold: it meets in the grid of the larger
    box, where the smaller one comes as a visitor, and counts in the cell that holds the overlap's first corner.
    Boxes that touch the same cells go through the join as one block. A pair of blocks is unfolded into pairs of places,
    which have their boxes' overlap worked out, and these into pairs of the rows that have these boxes.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    # One level more than the ratio asks for: a logarithm may round up.
    up = math.ceil(math.log2(1 / threshold)) + 1 if threshold < 1 else 1
    blocks = _blocks(df, keys, tie, extra)
    # Cells of k levels above a block's own. _fx, _fy: its boxes begin in this cell, so that pairs compare no coordinates to find the cell of their corner.
    high = lambda c, k: F.call_function("shiftright", F.col(c), k)
    span = lambda axis, k: F.sequence(high(f"_{axis}1", k), high(f"_{axis}2", k))
    cell = lambda k, x, y: F.struct((F.col("_own") + k).alias("_level"), x.alias("_cx"), y.alias("_cy"), (x == high("_x1", k)).alias("_fx"), (y == high("_y1", k)).alias("_fy"))
    cells = lambda k: F.flatten(F.transform(span("x", k), lambda x: F.transform(span("y", k), lambda y: cell(k, x, y))))
    at_home = blocks.select(*keys, "_block", "_places", F.inline(cells(F.lit(0))))
    visits = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(up)), cells))
    visitors = blocks.select(*keys, F.col("_own").alias("_from"), F.col("_block").alias("o_block"), F.col("_places").alias("o_places"), F.inline(visits)).withColumnsRenamed({"_fx": "o_fx", "_fy": "o_fy"})
    corner = [F.col("_f" + a) | F.col("o_f" + a) for a in "xy"]
    once = (F.col("_from") < F.col("_level")) | (F.col("_block") <= F.col("o_block"))
    met = at_home.join(visitors, [*keys, "_level", "_cx", "_cy"]).where(once & corner[0] & corner[1])
    same = (F.col("_from") == F.col("_level")) & (F.col("_block") == F.col("o_block"))
    place = [*COORDS, "_area", "_rows"]
    met = met.select(*keys, same.alias("_same"), "o_places", F.inline("_places").alias(*place))
    met = met.select(*keys, "_same", *place, F.inline("o_places").alias(*["o_" + c for c in place]))
    # iou() of boxes that have an area, known before they are paired. The number of the task isn't deterministic for Spark,
    # so it doesn't move the filter below this step and work each overlap out twice.
    side = lambda a: _if(f"{a}2 < o_{a}2", f"{a}2", f"o_{a}2") - _if(f"{a}1 < o_{a}1", f"o_{a}1", f"{a}1")
    met = met.withColumns({"_w": side("x"), "_h": side("y")})
    common = _if("_w > 0", "_w", "0D") * _if("_h > 0", "_h", "0D")
    met = met.withColumns({"iou": common / (F.col("_area") + F.col("o__area") - common), "_task": F.spark_partition_id()})
    met = met.where((F.col("iou") > threshold) & (F.col("_task") >= 0))
    row = [tie, *extra]
    kept = [*keys, "_same", *COORDS, *["o_" + c for c in COORDS], "iou"]
    pairs = met.select(*kept, "o__rows", F.inline("_rows").alias(*row)).select(*kept, *row, F.inline("o__rows").alias(*["o_" + c for c in row]))
    return pairs.where((F.col(tie) < F.col("o_" + tie)) | (~F.col("_same") & (F.col(tie) != F.col("o_" + tie)))).drop("_same")


def _if(test: str, then: str, other: str) -> Column:
    """A plain comparison: F.least() and F.greatest() cost more, where there are very many pairs."""
    return F.expr(f"if({test}, {then}, {other})")


def _blocks(df: DataFrame, keys: list[str], tie: str, extra: list[str]) -> DataFrame:
    """(keys, _own, _x1, _x2, _y1, _y2, _block, _places): a key's boxes of one level that touch the same cells, BLOCK at most.

    _own is the level of the boxes' grid, _x1 to _y2 are the cells they touch, _block is unique in a key and level. A
    place has a box's coordinates, its area and the (tie, extra) of all the block's rows that have this box.
    """
    level = F.ceil(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).cast("int")
    at = ["_own", "_x1", "_x2", "_y1", "_y2"]
    boxes = df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumn("_own", level)
    known = [F.coalesce(c, F.lit(0.0)).alias(c) for c in COORDS]  # none is null, which Spark can't tell
    boxes = boxes.select(*keys, tie, *extra, *known, "_own", *[F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_own"))).alias("_" + c) for c in ("x1", "x2", "y1", "y2")])
    number = F.row_number().over(W.Window.partitionBy(*keys, *at).orderBy(*COORDS, tie, *extra))
    boxes = boxes.withColumn("_part", F.floor((number - 1) / BLOCK))
    places = boxes.groupBy(*keys, *at, "_part", *COORDS).agg(F.collect_list(F.struct(tie, *extra)).alias("_rows"))
    blocks = places.groupBy(*keys, *at, "_part").agg(F.collect_list(F.struct(*COORDS, area(box()).alias("_area"), "_rows")).alias("_places"))
    return blocks.select(*keys, *at, F.struct(*at[1:], "_part").alias("_block"), "_places")


#: Boxes of a key that nms_dense() folds at once, the best undecided ones, and the share that a fold must settle of all
#: undecided boxes for another fold to follow.
FOLD, EFFECT = 256, 0.5


def nms_dense(df: DataFrame, keys: list[str], by: str, threshold: float, tie: str) -> DataFrame:
    """nms() for keys of any number of boxes: the same rows, without holding a key's boxes together.

    What is best in a key is decided by what is better still, so nms() of each key's FOLD best boxes is exact; what they
    keep drops its overlaps among all others, which leaves few of a crowd. This is repeated as long as it settles most
    boxes. The rest, with few overlaps, is settled by pairs, at a cost in proportion to these.
    """
    boxes = df.select(*keys, tie, by, *COORDS)
    undecided, kept, left = boxes, None, None
    while True:
        first = settle(_fold(undecided, keys, by, threshold, tie))
        kept = first if kept is None else kept.unionByName(first)
        undecided = settle(_unmet(undecided, first, keys, by, threshold, tie))
        before, left = boxes.count() if left is None else left, undecided.count()
        if not left or left > (1 - EFFECT) * before:
            break
    if left:
        kept = kept.unionByName(_by_pairs(undecided, keys, by, threshold, tie).select(*keys, tie))
    own = _matched(df, kept, [*keys, tie], "left_semi")
    return own.withColumn("_nms_rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(tie))))


def _fold(df: DataFrame, keys: list[str], by: str, threshold: float, tie: str) -> DataFrame:
    """What nms() keeps of each key's FOLD best boxes."""
    return nms(top_k(df, keys, by, FOLD, tie), keys, by, threshold, tie).select(*keys, tie, by, *COORDS)


def _unmet(df: DataFrame, kept: DataFrame, keys: list[str], by: str, threshold: float, tie: str) -> DataFrame:
    """The boxes behind a key's FOLD best that overlap none of kept, which has FOLD boxes a key at most."""
    last = first_rows(df, keys, [F.col(by).desc(), F.col(tie)], FOLD).select(*keys, tie)
    ours = kept.select(*keys, *[F.col(c).alias("k_" + c) for c in COORDS])
    return _matched(_matched(df, last, [*keys, tie], "left_anti"), ours, keys, "left_anti", iou(box(), box("k_")) > threshold)


def _matched(df: DataFrame, other: DataFrame, keys: list[str], how: str, *more: Column) -> DataFrame:
    """A semi or anti join in which a null key is a key."""
    named = other.withColumnsRenamed({k: "_of_" + k for k in keys})
    return df.join(named, [*[F.col(k).eqNullSafe(F.col("_of_" + k)) for k in keys], *more], how)


def _by_pairs(df: DataFrame, keys: list[str], by: str, threshold: float, tie: str) -> DataFrame:
    """The kept rows, by rounds over overlapping pairs.

    Each round keeps what no undecided better box overlaps and drops what that overlaps; rounds end when no pair is
    undecided, after at most as many as the longest chain of ever worse overlapping boxes.
    """
    node = lambda c: F.struct(*keys, F.col(c).alias(tie))
    better = (F.col(by) > F.col("o_" + by)) | ((F.col(by) == F.col("o_" + by)) & (F.col(tie) < F.col("o_" + tie)))
    pairs = _met(df, keys, tie, threshold, [by])
    undecided = settle(pairs.select(F.when(better, node(tie)).otherwise(node("o_" + tie)).alias("good"), F.when(better, node("o_" + tie)).otherwise(node(tie)).alias("bad")))
    gone = None
    while not undecided.isEmpty():
        sure = undecided.select("good").distinct().join(undecided.select(F.col("bad").alias("good")).distinct(), "good", "left_anti")
        dropped = settle(undecided.join(sure, "good", "left_semi").select("bad").distinct())
        gone = dropped if gone is None else gone.unionByName(dropped)
        undecided = settle(undecided.join(dropped.select(F.col("bad").alias("good")), "good", "left_anti").join(dropped, "bad", "left_anti"))
    return df if gone is None else df.join(gone.select("bad.*"), [*keys, tie], "left_anti")
