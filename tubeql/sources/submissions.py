"""Ground truth and submissions: nested JSON documents, one array of videos a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.box import COORDS, box, rounded
from . import arrays

NESTED = "array<struct<video_id:string,annotations:array<struct<bboxes:array<struct<frame:int,x1:double,y1:double,x2:double,y2:double>>>>>>"
ITEM = NESTED[6:-1]


def parse(texts: DataFrame, text: str = "value", order: str | None = None) -> DataFrame:
    """All boxes of JSON texts with their places: (doc, entry, annotation, item, video_id, frame, box).

    doc orders the texts: the column `order`, or the text itself.
    """
    return boxes(entries(texts, text, order))


def entries(texts: DataFrame, text: str = "value", order: str | None = None) -> DataFrame:
    """(doc, entry, e): the videos' entries of JSON texts. For tubes give this to last_tubes(): doc, which may be the text, is then no column of the boxes."""
    doc = F.col(order) if order else F.col(text)
    return texts.select(doc.alias("doc"), F.posexplode(F.from_json(text, NESTED)).alias("entry", "e"))


def scan(spark: SparkSession, *paths: str, range_bytes: int = arrays.RANGE) -> DataFrame:
    """(doc, entry, e): the videos' entries of files, by the place they have in them; a file is read by many tasks."""
    found = arrays.elements(spark, *paths, range_bytes=range_bytes)
    return found.select(F.col("path").alias("doc"), F.col("place").alias("entry"), F.from_json("value", ITEM).alias("e"))


def boxes(entries: DataFrame) -> DataFrame:
    """All boxes of entries, with their places."""
    notes = entries.select("doc", "entry", F.col("e.video_id").alias("video_id"), F.posexplode_outer("e.annotations").alias("annotation", "a"))
    own = notes.select("doc", "entry", "annotation", "video_id", F.posexplode_outer("a.bboxes").alias("item", "b"))
    return own.select("doc", "entry", "annotation", "item", "video_id", "b.*")


def _last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in {*keys, *order}]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_l")).select(*keys, *[F.col(f"_l.{c}") for c in rest])


def tubes(parsed: DataFrame) -> DataFrame:
    """(video_id, frame, box): of a video's entries the last counts, of a frame's boxes in it the last."""
    last = parsed.groupBy("video_id").agg(F.max(F.struct("doc", "entry")).alias("_e"))
    own = parsed.join(last, "video_id").where(F.struct("doc", "entry") == F.col("_e")).where(F.col("frame").isNotNull()).drop("_e", "doc", "entry")
    return _last(own, ["video_id", "frame"], ["annotation", "item"])


def last_tubes(entries: DataFrame) -> DataFrame:
    """As tubes(), of scan() or entries(): the last entry of a video is kept whole before it is taken apart, so that it is read once."""
    last = entries.where(F.col("e.video_id").isNotNull()).groupBy(F.col("e.video_id")).agg(F.max_by(F.struct("doc", "entry", "e"), F.struct("doc", "entry")).alias("_l"))
    own = boxes(last.select("_l.*")).where(F.col("frame").isNotNull())
    return _last(own.drop("doc", "entry"), ["video_id", "frame"], ["annotation", "item"])


def one_video(parsed: DataFrame, video_id: str) -> DataFrame:
    """(frame, box) of the first entry of a video; of a frame's boxes the last counts. An error if there is no entry."""
    own = parsed.where(F.col("video_id") == video_id)
    missing = F.raise_error(F.lit(f"no entry for video {video_id}"))
    first = own.agg(F.min(F.struct("doc", "entry")).alias("_e")).select(F.when(F.col("_e").isNull(), missing).otherwise(F.col("_e")).alias("_e"))
    found = own.join(F.broadcast(first), F.struct("doc", "entry") == F.col("_e")).where(F.col("frame").isNotNull())
    return _last(found.drop("_e", "doc", "entry", "video_id"), ["frame"], ["annotation", "item"])


def first_tube(entries: DataFrame, video_id: str) -> DataFrame:
    """As one_video(), of scan() or entries(): the first entry is kept whole before it is taken apart."""
    own = entries.where(F.col("e.video_id") == video_id)
    missing = F.raise_error(F.lit(f"no entry for video {video_id}"))
    first = own.agg(F.min_by("e", F.struct("doc", "entry")).alias("e")).select(F.lit(0).alias("doc"), F.lit(0).alias("entry"), F.when(F.col("e").isNull(), missing).otherwise(F.col("e")).alias("e"))
    return _last(boxes(first).where(F.col("frame").isNotNull()).drop("doc", "entry", "video_id"), ["frame"], ["annotation", "item"])


def video_ids(parsed: DataFrame) -> DataFrame:
    """The ids as they are listed, repeats included."""
    return parsed.select("doc", "entry", "video_id").distinct().select("video_id")


def read(spark: SparkSession, *paths: str, range_bytes: int = arrays.RANGE) -> DataFrame:
    """parse() of files, in order of their paths."""
    return boxes(scan(spark, *paths, range_bytes=range_bytes))


def rows(tube: DataFrame) -> DataFrame:
    """(video_id, frame, box in whole pixels), half to even; scores are dropped."""
    return tube.select("video_id", "frame", *rounded(box()).named())


def documents(tube: DataFrame) -> DataFrame:
    """(video_id, entry): each video's entry as JSON, frames in order."""
    boxes = F.array_sort(F.collect_list(F.struct("frame", *COORDS)))
    entry = F.struct(F.col("video_id").cast("string").alias("video_id"), F.array(F.struct(F.col("b").alias("bboxes"))).alias("annotations"))
    return rows(tube).groupBy("video_id").agg(boxes.alias("b")).select("video_id", F.to_json(entry).alias("entry"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the videos of new, and new."""
    return old.join(new.select("video_id").distinct(), "video_id", "left_anti").unionByName(new)


def write(tube: DataFrame, path: str) -> None:
    """Entries as JSON lines, a file a partition; each line is an array of one entry."""
    documents(tube).select(F.concat(F.lit("["), "entry", F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """parse() of what write() wrote."""
    return parse(spark.read.text(path))


def loocv_report(per_video: DataFrame, naive: DataFrame) -> DataFrame:
    """One row of JSON: the estimate, the naive best, and each video's fold."""
    folds = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("video_id").cast("string"), F.struct("z", F.round("held_out", 6).alias("st_iou"))))))
    one = per_video.agg(F.round(F.avg("held_out"), 6).alias("loocv_mean"), folds.alias("folds"))
    best = naive.agg(F.first("z").alias("best_z"), F.round(F.first("mean_st_iou"), 6).alias("naive_mean"))
    return one.join(F.broadcast(best)).select(F.to_json(F.struct("best_z", "naive_mean", "loocv_mean", "folds")).alias("report"))
