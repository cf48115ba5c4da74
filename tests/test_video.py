"""The uncompressed video source: pushed filters, bytes read, streams, and writes that leave nothing half done."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tubeql.sources import video
from tubeql.sources.video import Frames, Y4MReader, Y4MStream, Y4MWriter

W, H = 8, 4


def pixels(k, name="v"):
    return random.Random(f"{name}{k}").randbytes(3 * W * H)


def put(path, n, name="v", rate="30000:1001", mode="wb"):
    with open(path, mode) as f:
        if mode == "wb":
            f.write(f"YUV4MPEG2 W{W} H{H} F{rate} Ip A1:1 C444\n".encode())
        for k in range(n):
            f.write(b"FRAME\n" + pixels(k, name))


class Counted:
    """Counts what is read of files' frames."""

    def __init__(self, monkeypatch):
        self.bytes = 0
        real = video.opened

        def opened(path):
            system, place = real(path)
            outer = self

            class File:
                def __init__(self, f):
                    self.f = f

                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    self.f.close()

                def read_at(self, n, at):
                    outer.bytes += n
                    return self.f.read_at(n, at)

                def __getattr__(self, x):
                    return getattr(self.f, x)

            class System:
                def open_input_file(self, p):
                    return File(system.open_input_file(p))

                def __getattr__(self, x):
                    return getattr(system, x)

            return System(), place

        monkeypatch.setattr(video, "opened", opened)


@pytest.fixture
def folder(tmp_path):
    put(tmp_path / "a.y4m", 40, "a")
    put(tmp_path / "b.y4m", 17, "b")
    return str(tmp_path)


def rows_of(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_a_lookup_reads_one_frame_and_a_stride_an_eighth(folder, monkeypatch):
    count = Counted(monkeypatch)
    reader = Y4MReader({"path": folder})
    left = list(reader.pushFilters([video.EqualTo(("video_id",), "a"), video.EqualTo(("frame",), 23), video.EqualTo(("width",), 8)]))
    assert len(left) == 1  # what isn't understood stays with Spark
    assert rows_of(reader) == [("a", 23, W, H, 30000 / 1001, pixels(23, "a"))] and count.bytes == 6 + 3 * W * H
    count.bytes = 0
    found = rows_of(Y4MReader({"path": folder, "stride": "8", "frames_per_partition": "2"}))
    assert [r[1] for r in found] == [0, 8, 16, 24, 32, 0, 8, 16] and count.bytes == 8 * (6 + 3 * W * H)
    count.bytes = 0
    assert len(rows_of(Y4MReader({"path": folder, "payload": "false"}))) == 57 and count.bytes == 0


@pytest.mark.parametrize("filters, want", [
    ([video.GreaterThan(("frame",), 36)], [37, 38, 39]), ([video.LessThanOrEqual(("frame",), 2), video.GreaterThanOrEqual(("frame",), 1)], [1, 2]),
    ([video.In(("frame",), (5, 99, 3)), video.LessThan(("frame",), 5)], [3]), ([video.EqualTo(("frame",), 3), video.EqualTo(("frame",), 4)], []), ([video.GreaterThan(("frame",), 99)], []),
])
def test_filters_choose_frames_before_reading(folder, filters, want):
    for size in (1, 7, 256):
        reader = Y4MReader({"paths": f"{folder}/a.y4m", "frames_per_partition": str(size)})
        assert list(reader.pushFilters(filters)) == [] and sorted(r[1] for r in rows_of(reader)) == want


def test_through_spark(spark, folder):
    df = video.load(spark, folder, frames_per_partition=5)
    assert df.rdd.getNumPartitions() == 12 and df.count() == 57
    got = df.where("video_id = 'b' AND frame >= 3 AND frame < 6 AND width > 1").collect()
    assert [(r.video_id, r.frame, bytes(r.payload)) for r in got] == [("b", k, pixels(k, "b")) for k in (3, 4, 5)]
    plan = df.where("video_id = 'b' AND frame = 3")._jdf.queryExecution().toString()
    assert " = " not in plan.split("== Physical Plan ==")[1]  # Spark has nothing left to compare
    assert {(r.video_id, r.total_frames, r.width, r.height, round(r.fps, 3)) for r in video.metadata(spark, folder).collect()} == {("a", 40, W, H, 29.97), ("b", 17, W, H, 29.97)}
    assert bytes(video.frame(spark, folder, "a", 7).first().payload) == pixels(7, "a")
    with pytest.raises(Exception, match="no frame 40"):
        video.frame(spark, folder, "a", 40).select("frame", "payload").collect()


def test_files_that_are_wrong_are_errors(tmp_path):
    put(tmp_path / "v.y4m", 3)
    with open(tmp_path / "v.y4m", "ab") as f:
        f.write(b"FRAME\nabc")
    with pytest.raises(ValueError, match="9 bytes after 3 whole frames"):
        Y4MReader({"path": str(tmp_path)}).partitions()
    (tmp_path / "v.y4m").write_bytes(b"RIFF....AVI \n")
    with pytest.raises(ValueError, match="no YUV4MPEG2 header"):
        Y4MReader({"path": str(tmp_path)}).partitions()
    (tmp_path / "v.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F1:1 C420\n")
    with pytest.raises(ValueError, match="420"):
        Y4MReader({"path": str(tmp_path)}).partitions()
    (tmp_path / "v.y4m").write_bytes(b"YUV4MPEG2 W1 H1 F1:1 C444\nFRAME Ip\nab")  # a parameter shifts what follows
    with pytest.raises(ValueError):
        rows_of(Y4MReader({"path": str(tmp_path)}))
    with pytest.raises(FileNotFoundError):
        Y4MReader({"path": str(tmp_path / "nowhere")}).partitions()
    assert Y4MReader({}).partitions() == []


def test_a_stream_reads_what_was_appended(tmp_path):
    put(tmp_path / "v.y4m", 3)
    stream = Y4MStream({"path": str(tmp_path)})
    first = stream.latestOffset()
    assert [r[1] for p in stream.partitions(stream.initialOffset(), first) for r in stream.read(p)] == [0, 1, 2]
    with open(tmp_path / "v.y4m", "ab") as f:  # a whole frame, and the beginning of another
        f.write(b"FRAME\n" + pixels(3) + b"FRAME\nab")
    put(tmp_path / "w.y4m", 2, "w")
    second = stream.latestOffset()
    assert [(r[0], r[1]) for p in stream.partitions(first, second) for r in stream.read(p)] == [("v", 3), ("w", 0), ("w", 1)]
    assert stream.partitions(second, second) == []


def test_a_stream_through_spark(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source / "v.y4m", 4)
    video.register(spark)
    ask = lambda: spark.readStream.format("tubeql_y4m").option("path", str(source)).load().select("video_id", "frame").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    ask()
    put(source / "v.y4m", 2, mode="ab")
    ask()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.frame for r in got.collect()) == list(range(6))


def table(spark, videos):
    rows = [(name, k, W, H, 25.0, pixels(k, name)) for name, n in videos.items() for k in range(n)]
    return spark.createDataFrame(rows, video.SCHEMA).orderBy(F.rand(1))


def test_what_is_written_is_read_again(spark, tmp_path):
    df = table(spark, {"a": 9, "b": 1, "é c": 4})
    path = str(tmp_path / "out")
    video.save(df, path)
    back = video.load(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(os.listdir(path)) == ["a.y4m", "b.y4m", "é c.y4m"]
    with pytest.raises(Exception, match="FileExistsError"):
        video.save(table(spark, {"a": 2}), path)
    assert video.load(spark, path).where("video_id = 'a'").count() == 9 and not os.path.exists(f"{path}/_temporary")
    video.save(table(spark, {"a": 2}), path, "overwrite")
    assert video.load(spark, path).where("video_id = 'a'").count() == 2


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    broken = table(spark, {"a": 5, "b": 5}).where("NOT (video_id = 'b' AND frame = 3)")
    with pytest.raises(Exception, match="frame 4 follows 2"):
        video.save(broken, path)
    assert [x for x in os.listdir(path) if not x.startswith("_")] == [] and not os.path.exists(f"{path}/_temporary")


def test_killed_tasks_files_are_cleared_by_the_commit(tmp_path):
    writer = Y4MWriter({"path": str(tmp_path)}, False)
    rows = [{"video_id": "a", "frame": k, "width": W, "height": H, "fps": 25.0, "payload": pixels(k)} for k in range(3)]
    writer.write(iter(rows[:2]))  # an attempt whose message never came
    writer.commit([writer.write(iter(rows)), None])
    assert os.listdir(tmp_path) == ["a.y4m"]
    assert len(list(Frames(video.Video.of(str(tmp_path / "a.y4m")), 0, 3, 1, True).rows())) == 3
    with pytest.raises(ValueError, match="two tasks"):
        other = Y4MWriter({"path": str(tmp_path / "x")}, False)
        other.commit([other.write(iter(rows)), other.write(iter(rows))])
    assert os.listdir(tmp_path / "x") == []
