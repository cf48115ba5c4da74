"""Composite plans: proposals, candidates, detections and tubes from the single operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.box import area, box, rescale, shift
from ..operators import match, prototype, select, tiles, tube
from .config import Config

COLUMNS = ["video_id", "frame", "cand_id", "x1", "y1", "x2", "y2", "score", "source"]


def proposals(raw: DataFrame, tiled: bool, nms_iou: float = 0.5, min_area: float = 16.0, most: int = 400) -> DataFrame:
    """A model's boxes (video_id, frame, scale, prop_id, box, score; tiled: tx1, ty1 of the tile) per frame and scale.

    Tiled: to frame coordinates, suppressed across tiles. Then, still in the scaled frame's pixels, small boxes go
    and the best `most` stay.
    """
    keys = ["video_id", "frame", "scale"]
    if tiled:
        raw = raw.withColumns(dict(zip(("x1", "y1", "x2", "y2"), shift(box(), F.col("tx1"), F.col("ty1")))))
        raw = select.nms(raw, keys, "score", nms_iou, "prop_id").drop("_nms_rank")
    return select.top_k(raw.where(area(box()) >= min_area), keys, "score", most, "prop_id")


def candidates(props: DataFrame, dense: DataFrame | None = None, keyframes: DataFrame | None = None, nms_iou: float = 0.5, most: int = 400, trigger: int = 3, dense_most: int = 20) -> DataFrame:
    """Proposals of all scales as a frame's candidates; where there are fewer than trigger, with dense boxes.

    dense: (video_id, frame, cand_id, box, score), of ids that proposals don't have; keyframes: (video_id, frame).
    """
    keys = ["video_id", "frame"]
    scaled = props.withColumns(dict(zip(("x1", "y1", "x2", "y2"), rescale(box(), F.col("scale"))))).withColumn("cand_id", F.col("prop_id")).withColumn("source", F.lit("candidate"))
    found = select.nms(scaled.select(*COLUMNS), keys, "score", nms_iou, "cand_id").where(F.col("_nms_rank") <= most).drop("_nms_rank")
    if dense is None:
        return found
    enough = found.groupBy(*keys).count().where(F.col("count") >= trigger)
    starved = keyframes.select(*keys).distinct().join(enough, keys, "left_anti")
    few = select.top_k(dense.withColumn("source", F.lit("candidate_dense")).select(*COLUMNS).join(starved, keys, "left_semi"), keys, "score", dense_most, "cand_id")
    # One union and one suppression: frames that aren't starved have no dense boxes and keep what they have.
    return select.nms(found.unionByName(few), keys, "score", nms_iou, "cand_id").where(F.col("_nms_rank") <= most).drop("_nms_rank")


def detections(cands: DataFrame, refs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, thresholds, prototypes) of all videos in one plan."""
    m, r = config.matching, config.matching.refinement
    start = match.ref_list(refs) if m.multi_reference else prototype.fuse(refs, config.references.fusion, config.references.normalize)
    scored, protos = match.refine(cands, start, r.rounds if r.enabled else 0, r.alpha, r.percentile, r.floor, r.support, m.similarity, m.multi_reference)
    bars = match.thresholds(scored, m.adaptive, m.adaptive_z, m.adaptive_floor, m.match_threshold, m.similarity)
    return match.detect(scored, bars, m.global_topk, m.nms_iou, m.topk_per_keyframe), bars, protos


def final(tracks: DataFrame, config: Config) -> DataFrame:
    t = config.tubes
    return tube.final_tube(tracks, t.ema_alpha if t.smooth else None, t.fill_short_gaps, t.min_tube_length)


def sweep(scored: DataFrame, gt: DataFrame, zs: list[float], config: Config) -> DataFrame:
    """(z, z_order, video_id, st_iou): thresholds to evaluation for all z at once, z being a column.

    (z, video) stands for the video throughout, so the whole sweep is one plan.
    """
    from ..operators.evaluate import evaluate

    a = scored.groupBy("video_id").agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"), F.max("sim").alias("top"))
    bar = lambda z: F.least(F.greatest(F.col("m") + z * F.col("s"), F.lit(config.matching.adaptive_floor)), F.col("top"))
    # One row of thresholds a video; a candidate is multiplied only by the z that it passes.
    bars = a.select("video_id", F.array(*[F.struct(F.lit(float(z)).alias("z"), F.lit(i).alias("z_order"), bar(float(z)).alias("threshold")) for i, z in enumerate(zs)]).alias("bars"))
    passed = scored.join(bars, "video_id").withColumn("_z", F.explode(F.filter("bars", lambda b: F.col("sim") >= b["threshold"])))
    own = lambda z: F.struct(F.col(f"{z}.z_order").alias("z_order"), F.col("video_id"), F.col(f"{z}.z").alias("z"))
    wide = gt.withColumn("_z", F.explode(F.array(*[F.struct(F.lit(float(z)).alias("z"), F.lit(i).alias("z_order")) for i, z in enumerate(zs)])))
    m = config.matching
    found = match.kept(passed.withColumn("video_id", own("_z")), m.global_topk, m.nms_iou, m.topk_per_keyframe)
    first = found.where("det_rank = 1").select("video_id", "frame", "x1", "y1", "x2", "y2", "score")
    return evaluate(final(first, config), wide.withColumn("video_id", own("_z")).drop("_z")).select("video_id.z", "video_id.z_order", F.col("video_id.video_id").alias("video_id"), "st_iou")


def keyframe_frames(frames: DataFrame, config: Config) -> DataFrame:
    """Keyframes with their tiles and scales: what a proposal model is asked."""
    c = config.candidates
    out = tiles.scale_frames(tiles.keyframes(frames, c.keyframe_interval), c.scales)
    out = out.withColumns({k: F.floor(F.col(k) * F.col("scale")).cast("int") for k in ("width", "height")})
    return tiles.tile_frames(out, tuple(c.tile), c.overlap) if c.tiled else out
