"""Spatio-temporal IoU, recall, best and worst matches, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.box import COORDS, box, iou
from .select import first_rows


def frame_iou(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(video_id, frame, iou, in_pred, in_gt) over the frames of either; 0 where one lacks the frame."""
    p = pred.select("video_id", "frame", *[F.col(c).alias("p_" + c) for c in COORDS])
    g = gt.select("video_id", "frame", *[F.col(c).alias("g_" + c) for c in COORDS])
    both = p.join(g, ["video_id", "frame"], "full_outer")
    in_pred, in_gt = F.col("p_x1").isNotNull(), F.col("g_x1").isNotNull()
    return both.select("video_id", "frame", F.when(in_pred & in_gt, iou(box("p_"), box("g_"))).otherwise(F.lit(0.0)).alias("iou"), in_pred.alias("in_pred"), in_gt.alias("in_gt"))


def st_iou(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(video_id, st_iou, n_union) for each video of gt or pred."""
    return frame_iou(pred, gt).groupBy("video_id").agg(F.avg("iou").alias("st_iou"), F.count("*").alias("n_union"))


def evaluate(pred: DataFrame, gt: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """(video_id, st_iou) for the videos of gt; those without prediction have 0, others of pred don't count.

    videos: all of gt's videos, where some may have no frames.
    """
    names = (gt if videos is None else videos).select("video_id").distinct()
    return names.join(st_iou(pred, gt), "video_id", "left").select("video_id", F.coalesce("st_iou", F.lit(0.0)).alias("st_iou"))


def mean_st_iou(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """One row: the plain mean over videos; 0 without videos."""
    return evaluate(pred, gt).agg(F.coalesce(F.avg("st_iou"), F.lit(0.0)).alias("mean_st_iou"), F.count("*").alias("n_videos"))


def recall(candidates: DataFrame, gt: DataFrame, keyframes: DataFrame) -> DataFrame:
    """For each video of gt: its frames, those that are keyframes, and the best IoU of a candidate on them.

    A keyframe without candidates counts with 0.
    """
    g = gt.select("video_id", "frame", *[F.col(c).alias("g_" + c) for c in COORDS])
    on = g.join(keyframes.select("video_id", "frame").distinct(), ["video_id", "frame"], "left_semi")
    c = candidates.select("video_id", "frame", *[F.col(x).alias("c_" + x) for x in COORDS])
    value = F.when(F.col("c_x1").isNotNull(), iou(box("g_"), box("c_"))).otherwise(F.lit(0.0))
    best = on.join(c, ["video_id", "frame"], "left").groupBy("video_id", "frame").agg(F.max(value).alias("best"))
    per = best.groupBy("video_id").agg(F.count("*").alias("on_keyframe"), F.avg("best").alias("mean_best"), F.max("best").alias("max_best"), F.count_if(F.col("best") >= 0.3).alias("hits_03"), F.count_if(F.col("best") >= 0.5).alias("hits_05"))
    n = gt.groupBy("video_id").agg(F.count("*").alias("n_gt"))
    return n.join(per, "video_id", "left").select("video_id", "n_gt", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("on_keyframe", "long"), ("mean_best", "double"), ("max_best", "double"), ("hits_03", "long"), ("hits_05", "long"))])


def best_and_worst(detections: DataFrame, gt: DataFrame, tie: str) -> DataFrame:
    """For each video the frame whose first detection fits worst (the earliest of equals), and best (the latest)."""
    top = first_rows(detections, ["video_id", "frame"], [F.col("similarity").desc(), F.col(tie)], 1)
    scored = top.join(gt.select("video_id", "frame", *[F.col(c).alias("g_" + c) for c in COORDS]), ["video_id", "frame"]).withColumn("iou", iou(box(), box("g_")))
    ends = scored.groupBy("video_id").agg(F.min(F.struct("iou", "frame", "similarity")).alias("worst"), F.max(F.struct("iou", "frame", "similarity")).alias("best"))
    return ends.select("video_id", *[F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in ("worst", "best") for f in ("frame", "iou", "similarity")])


def best_z(sweep: DataFrame) -> DataFrame:
    """The z of highest mean over videos; of equals the first in order. sweep: (z, z_order, video_id, st_iou)."""
    return sweep.groupBy("z", "z_order").agg(F.avg("st_iou").alias("mean_st_iou")).orderBy(F.round("mean_st_iou", 12).desc(), "z_order").limit(1)


def loocv(sweep: DataFrame) -> DataFrame:
    """For each video the z that is best on all others, and the video's own value there.

    The mean of the others is the sum of all less one's own: no pairs of videos are made.
    """
    sums = sweep.groupBy("z").agg(F.sum("st_iou").alias("_sum"), F.count("*").alias("_n"))  # a row for each z, which the caller listed
    others = sweep.join(F.broadcast(sums), "z").withColumn("others", F.when(F.col("_n") > 1, (F.col("_sum") - F.col("st_iou")) / (F.col("_n") - 1)))
    ranked = first_rows(others, ["video_id"], [F.round("others", 12).desc(), F.col("z_order")], 1)
    return ranked.select("video_id", "z", F.col("others").alias("train_mean"), F.col("st_iou").alias("held_out"))
