"""Matching: candidates against prototypes, refinement, thresholds, and the detections of a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from . import select
from .shared import settle

#: Prototypes and references are one row a video; up to this many videos they are broadcast.
MAX_BROADCAST_VIDEOS = 10_000
#: Scores of a video that an aggregate may hold at once; beyond, its percentiles are found by counting.
MAX_HELD = 1_000_000
#: Bins of a video's range of scores, when counting.
BINS = 4_096


def _with(candidates: DataFrame, per_video: DataFrame, n_videos: int | None) -> DataFrame:
    """candidates with the one row of their video: broadcast if there are few videos, counted if n_videos is None.

    Otherwise the rows are settled first, so both sides of the join are plain exchanges, which Spark splits where one
    video has very many candidates.
    """
    if n_videos is None:
        per_video = settle(per_video)
        n_videos = per_video.count()
    return candidates.join(F.broadcast(per_video) if n_videos <= MAX_BROADCAST_VIDEOS else per_video, "video_id")


def quantile(scored: DataFrame, share: float, of: str = "sim", held: int | None = MAX_HELD) -> DataFrame:
    """(video_id, q): the exact percentile of each video's scores, between neighbours by a straight line.

    An aggregate holds a video's different scores; where a video has more than `held` rows, they are counted by bins
    of its range instead, and only the bins that hold the two neighbours are looked into, score by score. held None:
    the caller knows that none has.
    """
    if held is None:
        return scored.groupBy("video_id").agg(F.percentile(of, share).alias("q"))
    each = scored.groupBy("video_id").agg(F.count(of).alias("n"), F.min(of).alias("low"), F.max(of).alias("high"))
    most = each.agg(F.max("n")).first()[0] or 0
    if most <= held:
        return scored.groupBy("video_id").agg(F.percentile(of, share).alias("q"))
    at = (F.col("n") - 1) * share
    ranks = each.where(F.col("n") > 0).withColumns({"at": at, "k1": F.floor(at), "k2": F.ceil(at)})
    part = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    binned = scored.select("video_id", F.col(of).alias("v")).where(F.col("v").isNotNull()).join(ranks, "video_id").withColumn("bin", F.least(F.floor(part * BINS), F.lit(BINS - 1)))
    before = Window.partitionBy("video_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("video_id", "bin", "k1", "k2", "at").agg(F.count("*").alias("c")).withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0)))
    holds = lambda k: (F.col("first") <= F.col(k)) & (F.col(k) < F.col("first") + F.col("c"))
    wanted = bins.where(holds("k1") | holds("k2")).select("video_id", "bin", "first")
    values = binned.join(wanted, ["video_id", "bin"]).groupBy("video_id", "bin", "first", "k1", "k2", "at", "v").agg(F.count("*").alias("c"))
    inside = Window.partitionBy("video_id", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("first", F.col("first") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    ends = placed.groupBy("video_id", "at", "k1").agg(F.max(F.when(holds("k1"), F.col("v"))).alias("a"), F.max(F.when(holds("k2"), F.col("v"))).alias("b"))
    return ends.select("video_id", (F.col("a") + (F.col("at") - F.col("k1")) * (F.col("b") - F.col("a"))).alias("q"))


def score(candidates: DataFrame, prototypes: DataFrame, metric: str = "cosine", n_videos: int | None = None) -> DataFrame:
    """candidates with sim to their video's prototype (video_id, vec)."""
    return _with(candidates, prototypes.select("video_id", "vec"), n_videos).withColumn("sim", vec.similarity(F.col("feature"), F.col("vec"), metric)).drop("vec")


def ref_list(refs: DataFrame) -> DataFrame:
    """(video_id, vecs): a video's references in order."""
    listed = F.array_sort(F.collect_list(F.struct("ref_id", "feature")))
    return refs.groupBy("video_id").agg(F.transform(listed, lambda r: r["feature"]).alias("vecs"))


def score_multi(candidates: DataFrame, lists: DataFrame, metric: str = "cosine", n_videos: int | None = None) -> DataFrame:
    """candidates with sim, the mean over their video's vectors (video_id, vecs)."""
    each = F.transform("vecs", lambda r: vec.similarity(F.col("feature"), r, metric))
    return _with(candidates, lists.select("video_id", "vecs"), n_videos).withColumn("sim", vec.total(each) / F.size("vecs")).drop("vecs")


def high_confidence(scored: DataFrame, percentile: float = 90, floor: float = 0.15, held: int | None = MAX_HELD) -> DataFrame:
    """Scores at the percentile of their video or above, and at floor at least."""
    bar = quantile(scored, percentile / 100, held=held).select("video_id", F.greatest("q", F.lit(floor)).alias("bar"))
    return scored.join(bar, "video_id").where(F.col("sim") >= F.col("bar"))


def refine(candidates: DataFrame, prototypes: DataFrame, rounds: int = 2, alpha: float = 0.3, percentile: float = 90, floor: float = 0.15, support: int = 2, metric: str = "cosine", multi: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scored candidates, prototypes with updated): each round draws a video's prototype to its best candidates.

    Best are those at the percentile of the video's scores or above, and at floor at least. A video with fewer than
    `support` of them stops, for all further rounds. multi: the vectors' mean joins the video's list of vectors
    (video_id, vecs) instead. Videos that stop stay by left joins. The prototypes, a row a video, are settled after
    each round, so candidates are scored twice a round and not twice as often with every round.
    """
    key = "vecs" if multi else "vec"
    protos = settle(prototypes.select("video_id", key, F.lit(False).alias("updated"), F.lit(True).alias("going")))
    n_videos = protos.count()
    most = candidates.groupBy("video_id").count().agg(F.max("count")).first()[0] or 0 if rounds else 0
    rate = lambda p: (score_multi if multi else score)(candidates, p, metric, n_videos)
    for _ in range(rounds):
        scored = rate(protos)
        best = high_confidence(scored, percentile, floor, None if most <= MAX_HELD else MAX_HELD)
        mean = vec.elementwise(best, ["video_id"], "feature", "mean", count="n")
        found = mean.where(F.col("n") >= support).select("video_id", vec.normalize(F.col("mean"), "eps").alias("mean"))
        moves = F.col("going") & F.col("mean").isNotNull()
        new = F.concat(F.col("vecs"), F.array("mean")) if multi else vec.normalize(vec.blend(F.col("vec"), F.col("mean"), alpha), "eps")
        moved = protos.join(found, "video_id", "left").select("video_id", F.when(moves, new).otherwise(F.col(key)).alias(key), (F.col("updated") | moves).alias("updated"), moves.alias("going"))
        protos = settle(moved)
    return rate(protos), protos.drop("going")


def stats(scored: DataFrame, of: str = "sim") -> DataFrame:
    """(video_id, n, min, p50, mean, max) of the scores; the median is exact."""
    rest = scored.groupBy("video_id").agg(F.count("*").alias("n"), F.min(of).alias("min"), F.avg(of).alias("mean"), F.max(of).alias("max"))
    return rest.join(quantile(scored, 0.5, of), "video_id", "left").select("video_id", "n", "min", F.col("q").alias("p50"), "mean", "max")


def thresholds(scored: DataFrame, adaptive: bool = True, z: float = 1.5, floor: float = 0.05, fixed: float = 0.55, metric: str = "cosine") -> DataFrame:
    """(video_id, threshold): mean + z population deviations, at least floor (cosine), at most the best score."""
    if not adaptive:
        return scored.select("video_id").distinct().withColumn("threshold", F.lit(fixed))
    a = scored.groupBy("video_id").agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"), F.max("sim").alias("top"))
    raw = F.col("m") + z * F.col("s")
    return a.select("video_id", F.least(F.greatest(raw, F.lit(floor)) if metric == "cosine" else raw, F.col("top")).alias("threshold"))


def effective(videos: DataFrame, found: DataFrame, fixed: float = 0.55) -> DataFrame:
    """The threshold of each video; the fixed one where none was found."""
    return videos.select("video_id").distinct().join(found, "video_id", "left").select("video_id", F.coalesce("threshold", F.lit(fixed)).alias("threshold"))


def threshold_counts(scored: DataFrame, bars: list[float]) -> DataFrame:
    """(video_id, max, mean, p95 and for each bar the number of scores above it)."""
    counts = [F.count_if(F.col("sim") > b).alias(f"above_{i}") for i, b in enumerate(bars)]
    rest = scored.groupBy("video_id").agg(F.max("sim").alias("max"), F.avg("sim").alias("mean"), *counts)
    return rest.join(quantile(scored, 0.95).withColumnRenamed("q", "p95"), "video_id", "left").select("video_id", "max", "mean", "p95", *[f"above_{i}" for i in range(len(bars))])


def detect(scored: DataFrame, bars: DataFrame, global_topk: int | None = None, nms_iou: float = 0.5, topk: int = 5) -> DataFrame:
    """(video_id, frame, det_rank, cand_id, box, score, similarity, source): the matching's result.

    Scores at the threshold stay; of each video the global_topk best; of each frame what greedy suppression on
    similarity keeps, and of that the topk best. Boxes keep their own score.
    """
    return kept(scored.join(bars, "video_id").where(F.col("sim") >= F.col("threshold")), global_topk, nms_iou, topk)


def kept(passed: DataFrame, global_topk: int | None = None, nms_iou: float = 0.5, topk: int = 5) -> DataFrame:
    """detect() from the candidates that reach their threshold."""
    rows = passed.select("video_id", "frame", "cand_id", "x1", "y1", "x2", "y2", "score", "sim")
    rows = select.top_k(rows, ["video_id"], "sim", global_topk, "cand_id")
    out = select.nms(rows, ["video_id", "frame"], "sim", nms_iou, "cand_id").where(F.col("_nms_rank") <= topk)
    return out.select("video_id", "frame", F.col("_nms_rank").alias("det_rank"), "cand_id", "x1", "y1", "x2", "y2", "score", F.col("sim").alias("similarity"), F.lit("detect").alias("source"))
