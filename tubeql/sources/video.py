"""Uncompressed video (YUV4MPEG2, 4:4:4) as a source, a stream and a sink.

A file's header gives the size, the rate and the length of a frame, so that any frame's place is known: partitions are
runs of frames, filters on video_id and frame and the options `stride` and `payload` are settled before a byte of a
frame is read, and a frame that isn't asked for is skipped by a seek. A file whose frame headers have parameters of
their own (so that places can't be computed) is an error, as is one that ends inside a frame.

    spark.read.format("tubeql_y4m").option("paths", "a.y4m,b.y4m").load()
    (video_id string, frame int, width int, height int, fps double, payload binary)

Options: paths (or a path: a folder or a file), stride (every n-th frame, from 0), frames_per_partition, payload
("false": leave pixels unread, null). Paths may be URIs of any file system that Arrow knows.

Reading as a stream gives the frames that were appended, or came with new files, since the batch before; the offset is
the number of whole frames of each file. Writing takes (video_id, frame, width, height, fps, payload), one file a video
with frames in their order; a task writes to a file of its own name, and the driver's commit renames all files in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "video_id string, frame int, width int, height int, fps double, payload binary"
#: The format's marks.
MAGIC, FRAME, COLOR = b"YUV4MPEG2", b"FRAME\n", "444"
#: A header's bytes at most.
HEADER = 4_096
SUFFIX = ".y4m"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the place in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files(options) -> list[str]:
    """The files that paths and path name, folders' files by name."""
    out: list[str] = []
    for path in [p for p in [*options.get("paths", "").split(","), options.get("path", "")] if p]:
        system, place = opened(path)
        info = system.get_file_info(place)
        if info.type == pafs.FileType.Directory:
            found = system.get_file_info(pafs.FileSelector(place, recursive=True))
            prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
            out += sorted(prefix + f.path for f in found if f.path.endswith(SUFFIX) and not f.base_name.startswith((".", "_")))
        elif info.type == pafs.FileType.File:
            out.append(path)
        else:
            raise FileNotFoundError(path)
    return out


@dataclass(frozen=True)
class Video:
    """What a file's header and length say."""

    path: str
    width: int
    height: int
    rate: Fraction
    start: int  # of the first frame's header
    frames: int  # whole ones
    rest: int  # bytes after them

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1].removesuffix(SUFFIX)

    @property
    def size(self) -> int:
        return 3 * self.width * self.height

    @property
    def step(self) -> int:
        return len(FRAME) + self.size

    @staticmethod
    def of(path: str) -> Video:
        system, place = opened(path)
        with system.open_input_file(place) as f:
            head, length = f.read(HEADER), f.size()
        line, end, _ = head.partition(b"\n")
        words = line.split(b" ")
        if words[0] != MAGIC or not end:
            raise ValueError(f"{path}: no YUV4MPEG2 header in its first {HEADER} bytes")
        fields = {w[:1].decode(): w[1:].decode() for w in words[1:] if w}
        if fields.get("C", "420") != COLOR:
            raise ValueError(f"{path}: colour space {fields.get('C', '420')}; 444 is read")
        width, height = int(fields["W"]), int(fields["H"])
        top, _, low = fields.get("F", "25:1").partition(":")
        whole, rest = divmod(length - len(line) - 1, len(FRAME) + 3 * width * height)
        return Video(path, width, height, Fraction(int(top), int(low or 1)), len(line) + 1, whole, rest)


def read_frames(video: Video, numbers: Iterator[int], payload: bool) -> Iterator[tuple]:
    """Rows of these frames; what lies between them isn't read."""
    row = (video.width, video.height, float(video.rate))
    if not payload:
        for k in numbers:
            yield (video.name, k, *row, None)
        return
    system, place = opened(video.path)
    with system.open_input_file(place) as f:
        for k in numbers:
            data = f.read_at(video.step, video.start + k * video.step)
            if not data.startswith(FRAME) or len(data) < video.step:
                raise ValueError(f"{video.path}: frame {k} isn't where the header says")
            yield (video.name, k, *row, data[len(FRAME) :])


@dataclass(frozen=True)
class Frames(InputPartition):
    """Frames first, first + stride, ... below last of a video."""

    video: Video
    first: int
    last: int
    stride: int
    payload: bool

    def rows(self) -> Iterator[tuple]:
        return read_frames(self.video, range(self.first, self.last, self.stride), self.payload)


class Y4MSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tubeql_y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Y4MReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Y4MStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Y4MWriter(self.options, overwrite)


class Y4MReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.stride = int(options.get("stride", 1))
        self.run = int(options.get("frames_per_partition", 256))
        self.payload = options.get("payload", "true").lower() != "false"
        self.low, self.high = 0, 1 << 31
        self.only: set[int] | None = None
        self.videos: set[str] | None = None
        if self.stride < 1 or self.run < 1:
            raise ValueError("stride and frames_per_partition are 1 or more")

    def pushFilters(self, filters: list[Filter]):
        """Takes comparisons of frame, and of video_id with names; Spark keeps the others."""
        for f in filters:
            match f:
                case IsNotNull(("video_id" | "frame",)):
                    pass  # they never are
                case EqualTo(("video_id",), str(v)):
                    self.videos = {v} if self.videos is None else self.videos & {v}
                case In(("video_id",), vs):
                    self.videos = set(vs) if self.videos is None else self.videos & set(vs)
                case EqualTo(("frame",), int(v)):
                    self.only = {v} if self.only is None else self.only & {v}
                case In(("frame",), vs):
                    self.only = set(vs) if self.only is None else self.only & set(vs)
                case GreaterThan(("frame",), int(v)):
                    self.low = max(self.low, v + 1)
                case GreaterThanOrEqual(("frame",), int(v)):
                    self.low = max(self.low, v)
                case LessThan(("frame",), int(v)):
                    self.high = min(self.high, v)
                case LessThanOrEqual(("frame",), int(v)):
                    self.high = min(self.high, v + 1)
                case _:
                    yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files(self.options):
            if self.videos is not None and path.rsplit("/", 1)[-1].removesuffix(SUFFIX) not in self.videos:
                continue
            video = Video.of(path)
            if video.rest:
                raise ValueError(f"{path}: {video.rest} bytes after {video.frames} whole frames")
            low, high = max(0, self.low), min(self.high, video.frames)
            if self.only is not None:
                out += [Frames(video, k, k + 1, 1, self.payload) for k in sorted(self.only) if low <= k < high and k % self.stride == 0]
                continue
            first = -(-low // self.stride) * self.stride
            step = self.run * self.stride
            out += [Frames(video, k, min(k + step, high), self.stride, self.payload) for k in range(first, high, step)]
        return out

    def read(self, partition: Frames | None) -> Iterator[tuple]:
        """Spark asks for partition None where there is none."""
        return partition.rows() if partition is not None else iter(())


class Y4MStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)
        self.run = int(options.get("frames_per_partition", 256))

    def initialOffset(self) -> dict:
        return {"frames": "{}"}

    def latestOffset(self) -> dict:
        return {"frames": json.dumps({p: Video.of(p).frames for p in files(self.options)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, out = json.loads(start["frames"]), []
        for path, n in json.loads(end["frames"]).items():
            if n > before.get(path, 0):
                video = Video.of(path)
                out += [Frames(video, k, min(k + self.run, n), 1, True) for k in range(before.get(path, 0), n, self.run)]
        return out

    def read(self, partition: Frames) -> Iterator[tuple]:
        return partition.rows()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it lies, where it goes


class Y4MWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, rows: Iterator) -> Written:
        system, place = opened(self.path)
        system.create_dir(f"{place}/_temporary", recursive=True)
        out, names, now, stream = [], set(), None, None
        for r in rows:
            size = (r["width"], r["height"], r["fps"])
            if r["video_id"] != now:
                if stream:
                    stream.close()
                now, kind, last = r["video_id"], size, -1
                if now in names:
                    raise ValueError(f"{now}: rows of a video come together")
                names.add(now)
                held = f"{place}/_temporary/{uuid.uuid4().hex}"
                out.append((held, f"{place}/{now}{SUFFIX}"))
                stream = system.open_output_stream(held)
                rate = Fraction(r["fps"]).limit_denominator(1_001)
                stream.write(MAGIC + f" W{r['width']} H{r['height']} F{rate.numerator}:{rate.denominator} Ip A1:1 C{COLOR}\n".encode())
            if size != kind or len(r["payload"]) != 3 * r["width"] * r["height"] or r["frame"] != last + 1:
                raise ValueError(f"{now}: frame {r['frame']} follows {last}, or has another size")
            last = r["frame"]
            stream.write(FRAME + bytes(r["payload"]))
        if stream:
            stream.close()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = opened(self.path)
        done = [x for m in messages if m is not None for x in m.files]
        if len({new for _, new in done}) < len(done):
            self.abort(messages)
            raise ValueError("a video was written by two tasks")
        there = [new for _, new in done if system.get_file_info(new).type != pafs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(there[0])
        for held, new in done:
            system.move(held, new)
        self.clear(system, place)

    def abort(self, messages: list[Written | None]) -> None:
        system, place = opened(self.path)
        for held, _ in [x for m in messages if m is not None for x in m.files]:
            if system.get_file_info(held).type != pafs.FileType.NotFound:
                system.delete_file(held)
        self.clear(system, place)

    @staticmethod
    def clear(system: pafs.FileSystem, place: str) -> None:
        """Removes the folder of unfinished files, what killed tasks left in it included."""
        if system.get_file_info(f"{place}/_temporary").type == pafs.FileType.Directory:
            system.delete_dir(f"{place}/_temporary")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has Spark ask it about filters."""
    spark.dataSource.register(Y4MSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def save(frames: DataFrame, path: str, mode: str = "append") -> None:
    """frames (video_id, frame, width, height, fps, payload) as one file a video below path."""
    register(frames.sparkSession)
    rows = frames.select(*[n.split()[0] for n in SCHEMA.split(", ")]).repartition("video_id").sortWithinPartitions("video_id", "frame")
    rows.write.format("tubeql_y4m").mode(mode).save(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("tubeql_y4m").options(path=path, **options).load()


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, path, total_frames, fps, width, height) from the files' headers: no frame is read."""
    found = spark.createDataFrame([(p,) for p in files({"path": path})], "path string").repartition(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            videos = [Video.of(p) for p in b.column(0).to_pylist()]
            columns = [[v.name for v in videos], b.column(0), pa.array([v.frames for v in videos], pa.int64()), [float(v.rate) for v in videos], pa.array([v.width for v in videos], pa.int32()), pa.array([v.height for v in videos], pa.int32())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["video_id", "path", "total_frames", "fps", "width", "height"])

    return found.mapInArrow(run, "video_id string, path string, total_frames long, fps double, width int, height int")


def frame(spark: SparkSession, path: str, video_id: str, number: int) -> DataFrame:
    """One frame; an error where there is none."""
    row = load(spark, path).where((F.col("video_id") == video_id) & (F.col("frame") == number))
    found = row.agg(F.first(F.struct(*row.columns)).alias("row"))
    missing = F.raise_error(F.lit(f"{video_id}: no frame {number}")).cast(row.schema.simpleString())
    return found.select(F.when(F.col("row").isNull(), missing).otherwise(F.col("row")).alias("row")).select("row.*")
