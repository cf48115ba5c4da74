import pytest

from tubeql import fixtures as fx
from tubeql.operators import prototype, track
from tubeql.plans import composite, plugins, stages
from tubeql.plans.config import Config, coerce, load, merge, override
from tubeql.queries import QUERIES
from tubeql.sources import frames, labels, submissions
from tubeql.streaming.track import track_stream


def test_coercion_and_overrides():
    assert [coerce(x) for x in ("TRUE", "false", "null", "~", "none", "3", "3.5", "[1, 2]", '{"a": 1}', "[x", "text")] == [True, False, None, None, "none", 3, 3.5, [1, 2], {"a": 1}, "[x", "text"]
    assert override("a.b.c=1=2") == {"a": {"b": {"c": "1=2"}}}
    assert merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": 2}, "d": {"e": 1}}
    for bad in ("a.b", "a b=1", "=1"):
        with pytest.raises(ValueError):
            override(bad)


def test_load(tmp_path):
    (tmp_path / "c.yaml").write_text("matching: {adaptive: true, adaptive_z: 1.5}\n")
    c = load(str(tmp_path / "c.yaml"), ["matching.adaptive_z=2.5", "tracking.tracker=none"])
    assert c.matching.adaptive and c.matching.adaptive_z == 2.5 and c.tracking.tracker == "none"
    assert c.fingerprint("candidates") == Config().fingerprint("candidates") and c.fingerprint() != Config().fingerprint()
    for bad in ("tracking.tracker=model", "matching.unknown=1", "tubes.ema_alpha=0"):
        with pytest.raises(ValueError):
            load(None, [bad])


def test_stage_tables_follow_the_configuration(spark, sf, tmp_path):
    config = load(None, [f"project.work_dir={tmp_path}", "matching.adaptive=true", "matching.adaptive_z=1.5"])
    cands, refs = fx.cand_feat(spark, sf), prototype.ref_means(fx.refs(spark, sf))
    tube = stages.run_all(spark, config, cands, refs)
    want = composite.final(composite.detections(cands, refs, config)[0].where("det_rank = 1"), config)
    assert tube.count() == want.count() > 0
    other = load(None, [f"project.work_dir={tmp_path}", "matching.adaptive=true", "matching.adaptive_z=1.5", "tubes.min_tube_length=4"])
    assert stages.run_all(spark, other, cands, refs).count() < tube.count()
    assert len(list((tmp_path / "detections").iterdir())) == 1 and len(list((tmp_path / "tube").iterdir())) == 2
    with pytest.raises(ValueError):
        stages.run_all(spark, config, cands, refs, from_stage="nothing")


def test_video_source_and_plugins(spark):
    frames.register(spark)
    df = spark.read.format("tubeql_video").option("paths", "a:9,b:4").load()
    assert {r.video_id: (r.total_frames, r.fps) for r in frames.metadata(df).collect()} == {"a": (9, 10.0), "b": (4, 10.0)}
    keys = composite.keyframe_frames(df, load(None, ["candidates.keyframe_interval=4", "candidates.tile=[320,240]"]))
    found = plugins.propose(keys.select("video_id", "frame", "scale", "tile_id", "tx1", "ty1", "width", "height", "payload"))
    assert found.count() == 5 * keys.count() and sorted(map(str, found.collect())) == sorted(map(str, found.collect()))
    feats = plugins.embed(df.select("video_id", "frame", "payload")).collect()
    assert all(abs(sum(x * x for x in r.feature) - 1) < 1e-5 for r in feats)
    assert plugins.build("features", "ensemble").extract([b"x"]).shape == (1, 64)
    with pytest.raises(ValueError):
        plugins.build("proposals", "nothing")
    t = plugins.build("tracker", "constant")
    assert t.update(b"") == (None, 0.0)


def test_documents_last_wins_and_files(spark, tmp_path):
    entry = lambda v, *b: {"video_id": v, "annotations": [{"bboxes": [dict(zip(("frame", "x1", "y1", "x2", "y2"), x)) for x in g]} for g in b]}
    import json

    (tmp_path / "a.json").write_text(json.dumps([entry("v", [(1, 0, 0, 1, 1), (1, 0, 0, 2, 2)], [(1, 0, 0, 3, 3), (2, 0, 0, 4, 4)]), entry("w", [(5, 0, 0, 9, 9)]), entry("e")], indent=1))
    (tmp_path / "b.json").write_text(json.dumps([entry("w", [(6, 1, 1, 8, 8)])]))
    one = submissions.read(spark, str(tmp_path / "a.json"))
    assert sorted((r.video_id, r.frame, r.x2) for r in submissions.tubes(one).collect()) == [("v", 1, 3.0), ("v", 2, 4.0), ("w", 5, 9.0)]
    both = submissions.read(spark, str(tmp_path / "*.json"))
    assert sorted((r.video_id, r.frame) for r in submissions.tubes(both).collect()) == [("v", 1), ("v", 2), ("w", 6)]
    assert [r.frame for r in submissions.one_video(both, "w").collect()] == [5]
    assert sorted(r.video_id for r in submissions.video_ids(both).collect()) == ["e", "v", "w", "w"]
    assert submissions.one_video(both, "e").collect() == []
    with pytest.raises(Exception, match="no entry for video x"):
        submissions.one_video(both, "x").collect()
    tube = submissions.tubes(both)
    submissions.write(tube, str(tmp_path / "out"))
    back = submissions.tubes(submissions.read_lines(spark, str(tmp_path / "out")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tube.collect()))


def test_references_and_discovery(spark):
    files = spark.createDataFrame([(p,) for p in ("d/a/2.PNG", "d/a/1.jpg", "d/a/note.txt", "d/a/3.bmp", "d/b/1.jpg")], "path string")
    first = frames.references(files.where("path like 'd/a/%'"), 2)
    assert sorted((r.ref_id, r.path) for r in first.collect()) == [(0, "d/a/1.jpg"), (1, "d/a/2.PNG")]
    with pytest.raises(Exception, match="fewer than 2"):
        frames.references(files, 2).collect()
    assert {r.path for r in frames.discover(files).collect()} == {"d/a/1.jpg", "d/b/1.jpg"}


def test_label_remap(spark):
    images = spark.createDataFrame([("i",), ("j",)], "stem string")
    lines = spark.createDataFrame([("i", 1, " 2 .1 .2 "), ("i", 0, "2 .3"), ("i", 2, "1 .5"), ("i", 3, "")], "stem string, line_no int, line string")
    got = labels.keep_class(images, lines, 2, "p")
    assert sorted(map(tuple, got.collect())) == [("p_i", "0 .3\n0 .1 .2", 2), ("p_j", "", 0)]
    assert tuple(labels.counts(got).first()) == (2, 1)


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = fx.track_inputs(spark, sf).where("video_id < 3 AND frame < 120")
    rules = track.Rules(max_age=6)
    want = sorted(map(str, track.track(rows, rules).collect()))
    source = tmp_path / "in"
    for k in range(3):  # three batches, in order of frames
        rows.where(f"frame >= {40 * k} AND frame < {40 * k + 40}").coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        job = track_stream(stream, rules).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        job.awaitTermination(240)
        assert sorted(map(str, spark.table("tracked").collect())) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_texts_are_no_column_of_their_boxes(spark):
    """A document's text orders its entries; it goes with an entry, not with each of the boxes."""
    text = lambda n, x: '[{"video_id": "v", "annotations": [{"bboxes": [%s]}]}]' % ", ".join('{"frame": %d, "x1": %d, "y1": 0, "x2": %d, "y2": 1}' % (i, x, x + 1) for i in range(n))
    texts = spark.createDataFrame([(text(40, 1),), (text(30, 2),), ('[{"annotations": []}, {"video_id": "e"}]',)], "value string")
    got = submissions.last_tubes(submissions.entries(texts))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, submissions.tubes(submissions.parse(texts)).collect()))
    own = lambda df: sorted(map(tuple, df.collect()))
    assert own(submissions.first_tube(submissions.entries(texts), "v")) == own(submissions.one_video(submissions.parse(texts), "v"))
    with pytest.raises(Exception, match="no entry for video x"):
        submissions.first_tube(submissions.entries(texts), "x").collect()
    for name in ("gather_documents", "gt_round_trip", "gt_one_video"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and "Join" not in plan  # no boxes with their text that meet the last texts
