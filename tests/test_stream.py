"""The tracker over streams whose rows are out of order."""

import time

import pytest
from pyspark.sql import functions as F
from tubeql import fixtures as fx
from tubeql.operators import track
from tubeql.streaming.track import track_ordered

LATENESS = 10


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def rows(spark, sf):
    return fx.track_inputs(spark, sf).where("video_id < 3 AND frame < 150").cache()


def batches(rows, folder, step=50, reach=LATENESS):
    """Files in whose order a row comes at most `reach` frames after its place; a file's rows are shuffled."""
    moved = rows.withColumn("_at", F.col("frame") + F.pmod(F.xxhash64("video_id", "frame"), F.lit(reach + 1))).cache()
    top = moved.agg(F.max("_at")).first()[0]
    for k in range(0, top + 1, step):
        own = moved.where((F.col("_at") >= k) & (F.col("_at") < k + step)).drop("_at")
        own.orderBy(F.xxhash64("frame", "video_id")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, schema, tmp_path, name, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = track_ordered(stream, **options)
    job = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(240)
    return sorted(map(str, spark.read.schema(out.schema).parquet(str(tmp_path / name)).collect()))


def test_out_of_order_equals_batch(spark, rows, rocks, tmp_path):
    rules = track.Rules(max_age=6)
    batches(rows, str(tmp_path / "in"))
    want = sorted(map(str, track.track(rows, rules).where(f"frame <= {149 - LATENESS}").collect()))
    assert run(spark, str(tmp_path / "in"), rows.schema, tmp_path, "ordered", rules=rules, lateness=LATENESS) == want


def test_sides_and_late_rows(spark, rows, rocks, tmp_path):
    """Video 0 has a threshold of its own; video 1 a prototype; a row far behind is given out as late."""
    rows = rows.where("frame < 60").withColumn("trk_feature", F.when(F.col("frame") % 2 == 0, F.array("verify_sim", F.lit(0.25))))
    sides = spark.createDataFrame([(0, 0.9, None), (1, None, [0.5, 2.0])], "video_id long, threshold double, vec array<double>")
    folder = str(tmp_path / "in")
    for k in (0, 30):
        rows.where(f"frame >= {k} AND frame < {k + 30}").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.1)
    rows.where("video_id = 2 AND frame = 3").coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, folder, rows.schema, tmp_path, "sided", lateness=0, sides=sides)
    seen = F.when(F.col("trk_feature").isNotNull(), 0.5 * F.col("verify_sim") + 0.5)
    want = []
    for v, rules, used in ((0, track.Rules(threshold=0.9), rows), (1, track.Rules(), rows.withColumn("verify_sim", seen)), (2, track.Rules(), rows)):
        want += map(str, track.track(used.where(f"video_id = {v}"), rules).collect())
    assert any("late" in g for g in got)
    late = [g for g in got if "'late'" in g]
    assert len(late) == 1 and "video_id=2, frame=3, x1=None" in late[0]
    assert sorted(g for g in got if "'late'" not in g) == sorted(want)


def test_an_idle_video_is_released(spark, rows, rocks, tmp_path):
    """No row comes after the last ones; time passes."""
    folder = str(tmp_path / "in")
    own = rows.where("video_id = 0 AND frame < 40")
    want = sorted(map(str, track.track(own).collect()))
    own.coalesce(1).write.parquet(folder)
    out = track_ordered(spark.readStream.schema(rows.schema).parquet(folder), lateness=20, idle_ms=500)
    job = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until and spark.table("idle").count() < len(want):
            assert job.exception() is None
            time.sleep(1)
        assert sorted(map(str, spark.table("idle").collect())) == want
    finally:
        job.stop()
