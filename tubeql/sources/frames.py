"""Frames and reference images as tables, and a Python data source for decoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

IMAGES = r"(?i)\.(jpg|jpeg|png|bmp|webp)$"
SCHEMA = "video_id string, frame int, width int, height int, fps double, payload binary"
#: A decoder yields (frame, width, height, fps, payload) of a path, in order of frames.
Decoder = Callable[[str], Iterator[tuple[int, int, int, float, bytes]]]


def synthetic(path: str) -> Iterator[tuple[int, int, int, float, bytes]]:
    """A decoder for tests: path is "<name>:<frames>"."""
    for k in range(int(path.rsplit(":", 1)[1])):
        yield k, 640, 480, 10.0, k.to_bytes(2, "big")


DECODERS: dict[str, Decoder] = {"synthetic": synthetic}


class VideoSource(DataSource):
    """spark.read.format("tubeql_video").option("paths", "a.mp4,b.mp4").option("decoder", name).load(): a partition a video."""

    @classmethod
    def name(cls) -> str:
        return "tubeql_video"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VideoReader(self.options)


class VideoReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.decoder = options.get("decoder", "synthetic")
        if self.decoder not in DECODERS:
            raise ValueError(f"no decoder {self.decoder!r}; register one in DECODERS")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        video = partition.value.rsplit("/", 1)[-1].split(":")[0].rsplit(".", 1)[0]
        for frame, width, height, fps, payload in DECODERS[self.decoder](partition.value):
            yield video, frame, width, height, fps, payload


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VideoSource)


def metadata(frames: DataFrame) -> DataFrame:
    """(video_id, total_frames, fps, width, height) by what was decoded."""
    return frames.groupBy("video_id").agg(F.count("*").alias("total_frames"), F.max("fps").alias("fps"), F.max("width").alias("width"), F.max("height").alias("height"))


def discover(files: DataFrame) -> DataFrame:
    """(video_id, path): for each folder of (path) rows the first file by path; the folder's name is the video's."""
    folder = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(folder.alias("video_id")).agg(F.min("path").alias("path"))


def references(files: DataFrame, n: int) -> DataFrame:
    """(video_id, ref_id, path): the first n images of each folder by path; an error where there are fewer."""
    folder = F.element_at(F.split("path", "/"), -2)
    images = files.where(F.col("path").rlike(IMAGES)).select(folder.alias("video_id"), "path")
    w = Window.partitionBy("video_id")
    ranked = images.withColumn("ref_id", F.row_number().over(w.orderBy("path")) - 1).withColumn("_n", F.count("*").over(w))
    first = ranked.where(F.col("ref_id") < n)
    short = F.raise_error(F.concat(F.lit(f"fewer than {n} reference images: "), F.col("video_id"))).cast("int")
    return first.select("video_id", F.when(F.col("_n") < n, short).otherwise(F.col("ref_id")).alias("ref_id"), "path")


def sample(gt: DataFrame, stride: int) -> DataFrame:
    """Every stride-th of a video's frames with ground truth, from its first."""
    w = Window.partitionBy("video_id").orderBy("frame")
    return gt.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % stride == 0).drop("_n")
