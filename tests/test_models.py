"""Stages 1 to 4 from references and frames with stub models, as the configuration says."""

import re
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tubeql.operators import evaluate
from tubeql.plans import composite, models, plugins, stages
from tubeql.plans.config import Config, load
from tubeql.sources import frames as frame_source

KEYS = ["video_id", "frame"]
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class NearFeatures(plugins.StubFeatures):
    """All images look alike, up to a little that depends on the payload; one patch of a grid looks like them."""

    def extract(self, payloads):
        import numpy as np

        base = np.ones(self.dim) / np.sqrt(self.dim)
        out = np.stack([base + 0.1 * plugins._rng(p).normal(size=self.dim) / np.sqrt(self.dim) for p in payloads])
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def grid(self, payload, width, height, patch=14):
        import numpy as np

        out = np.zeros((6, 6, self.dim))
        out[1:3, 1:3] = np.ones(self.dim) / np.sqrt(self.dim)
        return out, 10.0, 10.0


@pytest.fixture(scope="module")
def inputs(spark):
    plugins.register("features", "near", lambda: NearFeatures(16))
    frame_source.register(spark)
    frames = spark.read.format("tubeql_video").option("paths", "a:12,b:9").load().drop("fps")
    images = spark.createDataFrame([(v, r, bytes([ord(v), r]), 224, 224) for v in "ab" for r in range(4)], "video_id string, ref_id int, payload binary, width int, height int")
    return images, frames


def settings(tmp_path, *more):
    base = ["candidates.keyframe_interval=4", "candidates.tiled=false", "matching.match_threshold=0.3", "matching.refinement.rounds=1", "tubes.min_tube_length=1", f"project.work_dir={tmp_path}"]
    return load(None, [*base, *more])


def test_reference_views_follow_the_configuration(spark, inputs, tmp_path):
    images, _ = inputs
    plain = models.reference_views(images, settings(tmp_path))
    assert plain.groupBy("video_id", "ref_id").count().collect() == plain.groupBy("video_id", "ref_id").count().where("count = 3 AND ref_id < 3").collect()
    # A mask of the whole image isn't plausible: the centre of 0.7 of each side counts.
    assert {round(r.mask_ratio, 3) for r in plain.collect()} == {round(157 * 157 / 224**2, 3)}
    more = models.reference_views(images, settings(tmp_path, "references.synthetic_views=2", "references.count=2", "references.scales=[1.0]"))
    got = more.collect()
    assert len(got) == 2 * 2 * 3 and sum(b'"kind":"camera"' in bytes(r.payload) for r in got) == 8
    other = models.reference_views(images, settings(tmp_path, "references.synthetic_views=2", "references.count=2", "references.scales=[1.0]", "references.seed=7"))
    assert {bytes(r.payload) for r in got} != {bytes(r.payload) for r in other.collect()}
    protos = models.prototypes(models.references(images, settings(tmp_path)), settings(tmp_path)).collect()
    assert len(protos) == 2 and all(abs(sum(x * x for x in r.vec) - 1) < 1e-6 for r in protos)


def test_masks_are_measured(spark):
    class Quarter:
        def mask(self, payload, width, height):
            import numpy as np

            out = np.zeros((height, width), dtype=bool)
            out[: height // 2, : width // 2] = True
            return out

    plugins.register("segmenter", "quarter", Quarter)
    df = spark.createDataFrame([(b"x", 40, 20)], "payload binary, width int, height int")
    assert plugins.segment(df, "quarter").first().mask_ratio == 0.25


def test_dense_scan_finds_the_blob_and_fills_starved_frames(spark, inputs, tmp_path):
    _, frames = inputs
    config = settings(tmp_path, "candidates.dense=true", "candidates.features=near", "candidates.dense_threshold=0.9", "candidates.dense_trigger=99")
    protos = spark.createDataFrame([(v, [0.25] * 16) for v in "ab"], "video_id string, vec array<double>")
    found = models.dense_boxes(frames, protos, config).collect()
    assert {(r.x1, r.y1, r.x2, r.y2) for r in found} == {(140.0, 140.0, 420.0, 420.0)} and len(found) == 6
    assert models.dense_boxes(frames, protos, settings(tmp_path, "candidates.features=near", "candidates.min_box_area=90000")).collect() == []
    cands = models.candidates(frames, protos, config)
    assert {r.source for r in cands.select("source").collect()} == {"candidate", "candidate_dense"}
    plain = models.candidates(frames, protos, settings(tmp_path, "candidates.features=near"))
    assert {r.frame % 4 for r in plain.collect()} == {0} and plain.count() < cands.count()


def test_run_is_its_single_steps_and_keeps_every_table(spark, inputs, tmp_path):
    images, frames = inputs
    config = settings(tmp_path, "candidates.features=near", "tracking.verify_interval=2")
    tube = stages.run_models(spark, config, images, frames)
    refs = models.references(images, config)
    protos = models.prototypes(refs, config)
    cands = models.candidates(frames, protos, config)
    dets, bars, refined = composite.detections(cands, refs, config)
    assert dets.count() > 0 and bars.count() == 2
    store = stages.Store(spark, config, images=images, frames=frames)
    assert all(store.has(s) for s in stages.SECTIONS)
    kept = store.table("thresholds", nothing)
    assert sorted(map(tuple, kept.select("video_id", "threshold").collect())) == sorted(map(tuple, bars.select("video_id", "threshold").collect()))
    tracked = store.table("tracks", nothing)
    assert tracked.count() == 21 and {r.source for r in tracked.collect()} <= {"detect", "track", "none"}
    first = {tuple(r) for r in dets.where("det_rank = 1").select(*KEYS).collect()}
    assert {tuple(r) for r in tracked.where("source = 'detect'").select(*KEYS).collect()} >= first
    want = composite.final(tracked, config)
    pick = lambda df: sorted(map(str, df.select(*KEYS, "x1", "y1", "x2", "y2").collect()))
    assert pick(tube) == pick(want) and tube.count() > 0
    with pytest.MonkeyPatch.context() as m:
        for name in ("references", "prototypes", "candidates", "tracks"):
            m.setattr(models, name, nothing)
        again = stages.run_models(spark, config, images, frames.orderBy("frame"))
    assert pick(again) == pick(tube)  # every table is read, none made
    assert {r.video_id for r in stages.run_models(spark, config, images, frames.where("video_id = 'a'")).collect()} == {"a"}  # other videos, other tables


def nothing(*_):
    raise AssertionError("a table was made again")


def test_stage_tables_depend_on_plug_ins_and_inputs(spark, inputs, tmp_path):
    images, frames = inputs
    of = lambda *more, **tables: {s: stages.Store(spark, settings(tmp_path, *more), **tables).key(s) for s in stages.SECTIONS}
    base = of(images=images, frames=frames)
    assert base == of(images=images.orderBy("payload"), frames=frames.repartition(3))
    plugins.register("pixels", "other", plugins.DescribedPixels)
    plugins.register("tracker", "none", plugins.REGISTRY["tracker"]["none"])
    for other in (of("project.pixels=other", images=images, frames=frames), of(images=images, frames=frames.where("frame > 0")), of(images=images.unionAll(images.limit(1)), frames=frames)):
        assert all(base[s] != other[s] for s in stages.SECTIONS)

    class Changed(plugins.DescribedPixels):
        version = "2"

    plugins.register("pixels", "other", Changed)
    assert of("project.pixels=other", images=images, frames=frames) not in (base, of(images=images, frames=frames))
    tracked = of("tracking.verify_interval=2", images=images, frames=frames)
    assert {s for s in stages.SECTIONS if tracked[s] != base[s]} == {"tracks", "tube"}


def test_ids_come_back_as_they_were(spark, tmp_path):
    rows = [("007", 1, 0.5), ("010", 2, None), ("é/ =x", 3, 1.5), ("7", 4, 2.5)]
    df = spark.createDataFrame(rows, "video_id string, frame int, score double")
    got = stages.Store(spark, settings(tmp_path)).table("tracks", lambda: df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and got.dtypes == df.dtypes


def test_two_writers_leave_one_whole_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = stages.Store(spark, settings(tmp_path))
    make = lambda k: lambda: spark.range(50).selectExpr("cast(id % 5 as string) video_id", "cast(id as int) frame", f"{k} who")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store.table("tube", make(k), force=True), range(4)))
    now = stages.Store(spark, settings(tmp_path)).table("tube", nothing)
    assert now.count() == 50 and now.select("who").distinct().count() == 1
    before = store.table("tube", nothing)

    def fails():
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        store.table("tube", fails, force=True)
    store.table("tube", make(9), force=True)  # a reader of the version before isn't disturbed
    assert before.select("who").distinct().collect() == now.select("who").distinct().collect() != store.table("tube", nothing).select("who").distinct().collect()


def test_tracking_without_tracker_detects_on_every_frame(spark, inputs, tmp_path):
    _, frames = inputs
    config = settings(tmp_path, "candidates.features=near", "tracking.tracker=none")
    protos = spark.createDataFrame([(v, [0.25] * 16) for v in "ab"], "video_id string, vec array<double>")
    none = spark.createDataFrame([], "video_id string, frame int, det_rank int, x1 double, y1 double, x2 double, y2 double, score double")
    found = models.tracks(frames, none, none.selectExpr("video_id", "score AS threshold"), protos, config)
    assert {r.source for r in found.collect()} == {"detect"} and found.count() == 21
    strict = settings(tmp_path, "candidates.features=near", "tracking.tracker=builtin", "matching.match_threshold=2.0")
    assert {r.source for r in models.tracks(frames, none, none.selectExpr("video_id", "score AS threshold"), protos, strict).collect()} == {"none"}


class CropFeatures:
    """A unit vector that turns with the left and top side of the crop that the payload describes."""

    dim = 3

    def extract(self, payloads):
        import json

        import numpy as np

        out = []
        for p in payloads:
            b = json.loads(bytes(p)[bytes(p).index(b"{") :])["box"]
            out.append([np.cos(b["x1"] / 150), np.sin(b["x1"] / 150), np.cos(b["y2"] / 90)])
        return np.array(out) / np.linalg.norm(out, axis=1, keepdims=True)


def found_again(video, frame, payload, size, tiled, vecs, threshold):
    """Plain Python: the best of a frame's boxes, or None."""
    import json

    import numpy as np

    model, boxes = plugins.StubProposals(), []
    if tiled:
        starts = lambda side: [0] if side <= 640 else sorted({min(480 * i, side - 640) for i in range(-(-(side - 640) // 480) + 1)})
        for y in starts(size[1]):
            for x in starts(size[0]):
                t = {"tx1": x, "ty1": y, "tx2": min(x + 640, size[0]), "ty2": min(y + 640, size[1])}
                spec = json.dumps({"kind": "tile", "scale": 1.0, "tile": t}).replace(" ", "")
                boxes += [(a + x, b + y, c + x, d + y, s) for a, b, c, d, s in model.propose(payload + spec.encode(), t["tx2"] - x, t["ty2"] - y)]
        kept = []
        for b in sorted(boxes, key=lambda b: -b[4]):
            area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
            meet = lambda q: max(0, min(b[2], q[2]) - max(b[0], q[0])) * max(0, min(b[3], q[3]) - max(b[1], q[1]))
            if all(meet(k) / (area(b) + area(k) - meet(k)) <= 0.5 for k in kept):
                kept.append(b)
        boxes = kept
    else:
        boxes = model.propose(payload + b'{"kind":"frame","scale":1.0}', *size)
    boxes = [b[:4] for b in boxes if (b[2] - b[0]) * (b[3] - b[1]) >= 9_000][:4]
    best = None
    for b in boxes:
        px, py = 0.2 * (b[2] - b[0]), 0.2 * (b[3] - b[1])
        crop = {"x1": max(0, int(b[0] - px)), "y1": max(0, int(b[1] - py)), "x2": min(size[0], int(b[2] + px)), "y2": min(size[1], int(b[3] + py))}
        sim = float(np.mean([CropFeatures().extract([b"" + json.dumps({"box": crop}).encode()])[0] @ np.array(v) for v in vecs]))
        if best is None or sim > best[0]:
            best = (sim, b)
    return best[1] if best and best[0] >= threshold else None


@pytest.mark.parametrize("tiled,multi", [(True, False), (True, True), (False, False)])
def test_what_is_found_again_equals_plain_python(spark, tmp_path, tiled, multi):
    plugins.register("features", "crop", CropFeatures)
    size = (1500, 700)
    shots = [(v, f, bytes([ord(v), f]), *size) for v in "abc" for f in range(12)]
    frames = spark.createDataFrame(shots, "video_id string, frame int, payload binary, width int, height int")
    config = settings(tmp_path, "candidates.features=crop", "tracking.tracker=none", f"candidates.tiled={str(tiled).lower()}", "candidates.min_box_area=9000", "candidates.max_per_keyframe=4", "candidates.crop_pad=0.2", f"matching.multi_reference={str(multi).lower()}")
    own = {"a": [[0.6, 0.0, 0.8]], "b": [[0.0, 1.0, 0.0]]}  # c has no vector: nothing is found again
    lists = {v: [*x, [0.0, 0.6, 0.8]] for v, x in own.items()}
    protos = spark.createDataFrame([(v, x[0]) for v, x in own.items()], "video_id string, vec array<double>")
    refs = spark.createDataFrame([(v, r, f) for v, x in lists.items() for r, f in enumerate(x)], "video_id string, ref_id int, feature array<double>")
    none = spark.createDataFrame([], "video_id string, frame int, det_rank int, x1 double, y1 double, x2 double, y2 double, score double")
    bars = spark.createDataFrame([("a", 0.4)], "video_id string, threshold double")
    got = {(r.video_id, r.frame): (r.source, tuple(r)[2:6]) for r in models.tracks(frames, none, bars, protos, config, refs).collect()}
    assert len(got) == len(shots)
    for v, f, payload, *_ in shots:
        used = (lists if multi else own).get(v)
        want = used and found_again(v, f, payload, size, tiled, used, 0.4 if v == "a" else 0.3)
        assert got[v, f] == (("detect", pytest.approx(want)) if want else ("none", (None,) * 4))
    assert 0 < sum(s == "detect" for s, _ in got.values()) < 24


def test_report_is_sorted_and_ends_with_the_mean(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", 0.25)], "video_id string, st_iou double")
    assert [r.line for r in models.report(rows).collect()] == ["a: 0.2500", "b: 0.5000", "mean ST-IoU: 0.3750 over 2"]
    assert evaluate.mean_st_iou is not None


def test_every_setting_is_read():
    """No setting is declared that no code outside the configuration names."""
    source = "\n".join(p.read_text() for p in Path(composite.__file__).parents[1].rglob("*.py") if "llm" not in p.parts and p.name != "config.py")
    names = {n for s in Config.model_fields.values() for n in s.annotation.model_fields} | set(type(Config().matching.refinement).model_fields)
    assert [n for n in sorted(names) if not re.search(rf"\.{n}\b", source)] == []
