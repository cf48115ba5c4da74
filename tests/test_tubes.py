import random

import pytest

from tubeql.operators import blobs, evaluate, match, prototype, track, tube
from tubeql.plans import composite
from tubeql.plans.config import Config

ROW = "video_id long, frame int, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, frames, box, video=1):
    return spark.createDataFrame([(video, f, *map(float, box)) for f in frames], ROW)


CASES = [
    (range(0, 3), (10, 10, 50, 50), range(0, 3), (10, 10, 50, 50), 1.0), (range(0, 3), (10, 10, 50, 50), range(3, 6), (10, 10, 50, 50), 0.0), (range(0, 5), (0, 0, 10, 10), range(3, 8), (0, 0, 10, 10), 0.25),
    (range(0, 2), (0, 0, 10, 10), range(0, 2), (5, 5, 15, 15), 25 / 175), (range(1, 3), (0, 0, 9, 9), range(0, 3), (0, 0, 9, 9), 2 / 3),
]


@pytest.mark.parametrize("pf,pb,gf,gb,want", CASES)
def test_st_iou_closed_forms(spark, pf, pb, gf, gb, want):
    p, g = boxes(spark, pf, pb), boxes(spark, gf, gb)
    assert abs(evaluate.st_iou(p, g).first().st_iou - want) < 1e-9
    assert abs(evaluate.st_iou(g, p).first().st_iou - want) < 1e-9


def test_empty_tubes(spark):
    none = spark.createDataFrame([], ROW)
    assert evaluate.mean_st_iou(none, none).first().mean_st_iou == 0.0
    named = spark.createDataFrame([(1,)], "video_id long")
    assert evaluate.evaluate(none, none, named).first().st_iou == 0.0
    assert evaluate.evaluate(boxes(spark, [0], (0, 0, 1, 1), 7), boxes(spark, [0], (0, 0, 1, 1), 8)).collect() == [(8, 0.0)]


def test_tube_stage_properties(spark):
    rng = random.Random(3)
    rows = []
    for v in range(4):
        f = 0
        for _ in range(80):
            f += rng.choice([1, 1, 1, 2, 3, 5, 9])
            rows.append((v, f, rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(60, 90), rng.uniform(60, 90), rng.random()))
    df = spark.createDataFrame(rows, ROW + ", score double")
    for alpha in (0.6, 0.05, 1.0):
        state, want = {}, {}
        for r in sorted(rows):
            s = state.get(r[0])
            state[r[0]] = s = r[2] if s is None else alpha * r[2] + (1 - alpha) * s
            want[r[:2]] = s
        got = {(r.video_id, r.frame): r.x1 for r in tube.ema(df, alpha).collect()}
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    filled = tube.fill_gaps(df, 3).collect()
    for v in range(4):
        own = sorted(r[1] for r in rows if r[0] == v)
        extra = {f for a, b in zip(own, own[1:]) if 1 <= b - a - 1 <= 3 for f in range(a + 1, b)}
        assert sorted(r.frame for r in filled if r.video_id == v) == sorted({*own, *extra})
    for r in tube.segments(df).collect():
        assert r.segment_len >= 1
    with pytest.raises(ValueError):
        tube.ema(df, 0.0)


def test_threshold_cap_goes_below_the_floor(spark):
    scored = spark.createDataFrame([(1, 0.01), (1, 0.02), (2, 0.5), (2, 0.7)], "video_id long, sim double")
    got = {r.video_id: r.threshold for r in match.thresholds(scored, z=5.0).collect()}
    assert got == {1: 0.02, 2: 0.7}
    assert {r.threshold for r in match.thresholds(scored, adaptive=False, fixed=0.55).collect()} == {0.55}


def test_refinement_stops_where_support_is_missing(spark):
    rows = [(1, i, [1.0, 0.1 * i]) for i in range(20)] + [(2, i, [0.01 * i, -1.0]) for i in range(20)]
    c = spark.createDataFrame(rows, "video_id long, cand_id long, feature array<double>")
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "video_id long, vec array<double>")
    got = {r.video_id: (r.updated, r.vec) for r in match.refine(c, p, floor=0.5)[1].collect()}
    assert got[1][0] and got[1][1] != [1.0, 0.0] and got[2] == (False, [1.0, 0.0])


def test_pca_is_the_first_axis(spark):
    refs = spark.createDataFrame([(1, i, [float(i), 0.0, 1.0], 0.5) for i in range(3)], "video_id long, ref_id int, feature array<double>, mask_ratio double")
    assert [round(x, 9) for x in prototype.fuse(refs, "pca").first().vec] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        prototype.fuse(refs, "sum")


def test_blob_golden(spark):
    rows = [(1, x, y, 1.0 if 3 <= x < 6 and 3 <= y < 6 else 0.0) for x in range(10) for y in range(10)]
    grid = spark.createDataFrame(rows, "tile long, gx int, gy int, sim double")
    (b,) = blobs.blob_boxes(blobs.blobs(grid, ["tile"], 0.5)).collect()
    assert (b.x1, b.y1, b.x2, b.y2, b.score, b.n_patches) == (42, 42, 84, 84, 1.0, 9)
    assert blobs.blobs(grid, ["tile"], 1.5).collect() == [] and blobs.blobs(grid, ["tile"], 0.5, 100).collect() == []
    diagonal = spark.createDataFrame([(1, i, i, 1.0) for i in range(6)] + [(1, 9, 0, 1.0)], "tile long, gx int, gy int, sim double")
    assert [r.n_patches for r in blobs.blobs(diagonal, ["tile"], 0.5).collect()] == [6]


def test_homography_of_no_turn_is_the_identity(spark):
    assert abs(prototype.homography(0, 0, 640, 480) - [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).max() < 1e-9
    refs = spark.createDataFrame([(1, 0, 640, 480)], "video_id long, ref_id int, width int, height int")
    views = prototype.synthetic_views(refs, 6, (40.0, 85.0)).collect()
    assert len(views) == 6 and all(40 <= r.pitch <= 85 and -15 <= r.yaw <= 15 and len(r.matrix) == 9 for r in views)


def test_sweep_is_the_single_runs(spark, sf):
    from tubeql import fixtures as fx
    from tubeql.queries import _proto

    scored = match.score(fx.cand_feat(spark, sf), _proto(spark, sf))
    gt = fx.gt(spark, sf)
    wide = {(r.z, r.video_id): r.st_iou for r in composite.sweep(scored, gt, [1.0, 2.0], Config()).collect()}
    for z in (1.0, 2.0):
        found = match.detect(scored, match.thresholds(scored, z=z)).where("det_rank = 1")
        for r in evaluate.evaluate(composite.final(found, Config()), gt).collect():
            assert abs(wide[z, r.video_id] - r.st_iou) < 1e-9


def test_loocv_excludes_the_held_out_video(spark):
    rows = [(1.0, 0, 1, 0.9), (1.0, 0, 2, 0.1), (1.0, 0, 3, 0.1), (2.0, 1, 1, 0.0), (2.0, 1, 2, 0.3), (2.0, 1, 3, 0.3)]
    s = spark.createDataFrame(rows, "z double, z_order int, video_id long, st_iou double")
    assert {r.video_id: (r.z, r.held_out) for r in evaluate.loocv(s).collect()} == {1: (2.0, 0.0), 2: (1.0, 0.1), 3: (1.0, 0.1)}
    assert evaluate.best_z(s).first().z == 1.0


def test_state_machine_rules():
    row = {f"{p}_{c}": None for p in ("det", "trk", "red") for c in ("x1", "y1", "x2", "y2")} | {"trk_conf": 0.9, "verify_sim": 0.9}
    box = lambda p: {f"{p}_{c}": 1.0 for c in ("x1", "y1", "x2", "y2")}
    s, rules = track.State(), track.Rules(max_age=2, verify_interval=0)
    assert track.step(s, row | box("trk"), rules) == (None, "none")
    assert track.step(s, row | box("det"), rules)[1] == "detect" and s.active
    assert [track.step(s, row | box("trk"), rules)[1] for _ in range(3)] == ["track", "track", "none"]
    assert track.step(s, row | box("red"), rules)[1] == "none"  # inactive: no detection is tried
    s = track.State(True, 0, 4)
    assert track.step(s, row | box("trk") | box("red") | {"verify_sim": 0.1}, track.Rules())[1] == "detect" and s.since == 0


def test_ema_is_the_fold_at_any_alpha_and_batch(spark):
    rows = [(v, f, *[float((f * k + v) % 17) for k in (3, 5, 7, 11)], "x") for v in (1, 2) for f in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "video_id long, frame int, x1 double, y1 double, x2 double, y2 double, tag string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        for alpha in (0.6, 0.001, 1.0):
            got = {(r.video_id, r.frame): (r.x1, r.y1, r.x2, r.y2, r.tag) for r in tube.ema(df, alpha).collect()}
            for v in (1, 2):
                state = None
                for r in [r for r in rows if r[0] == v]:
                    state = r[2:6] if state is None else tuple(alpha * b + (1 - alpha) * s for b, s in zip(r[2:6], state))
                    assert got[v, r[1]][:4] == pytest.approx(state, abs=1e-9) and got[v, r[1]][4] == "x"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("share", [0.0, 0.37, 0.5, 0.9, 1.0])
def test_quantile_by_counting_is_the_percentile(spark, share):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {1: rng.normal(size=2000), 2: np.full(50, 0.25), 3: np.array([0.5]), 4: np.round(rng.uniform(size=900), 1), 5: np.append(np.zeros(500), 1e9)}
    df = spark.createDataFrame([(v, float(x)) for v, xs in values.items() for x in xs] + [(1, None)], "video_id long, sim double")
    for held in (1, match.MAX_HELD):
        got = {r.video_id: r.q for r in match.quantile(df, share, held=held).collect()}
        assert got == {v: pytest.approx(float(np.quantile(xs, share)), abs=1e-9) for v, xs in values.items()}


def test_fallbacks_for_missing_videos(spark):
    """A video without prediction counts with 0, one without ground truth doesn't; thresholds and prototypes fall back."""
    boxes = lambda *videos: spark.createDataFrame([(v, 0, 0.0, 0.0, 10.0, 10.0) for v in videos], "video_id long, frame int, x1 double, y1 double, x2 double, y2 double")
    assert tuple(evaluate.mean_st_iou(boxes(1, 5), boxes(1, 3)).first()) == (0.5, 2)
    bars = spark.createDataFrame([(1, 0.3)], "video_id long, threshold double")
    assert {r.video_id: r.threshold for r in match.effective(boxes(1, 3), bars, 0.55).collect()} == {1: 0.3, 3: 0.55}
    base = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "video_id long, vec array<double>")
    got = {r.video_id: (r.vec, r.source) for r in prototype.best_of(base, base.where("video_id = 1").selectExpr("video_id", "array(9.0D) AS vec")).collect()}
    assert got == {1: ([9.0], "dynamic"), 3: ([2.0], "base")}


def test_prototypes_are_sent_only_if_they_are_few(spark, capsys):
    cands = spark.createDataFrame([(1, [1.0, 0.0])], "video_id long, feature array<double>")
    protos = spark.createDataFrame([(1, [1.0, 0.0])], "video_id long, vec array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        match.score(cands, protos).explain()
        assert "BroadcastHashJoin" in capsys.readouterr().out
        match.score(cands, protos, n_videos=match.MAX_BROADCAST_VIDEOS + 1).explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block", [1, 7, 64])
def test_scans_in_blocks_are_the_scans_over_the_video(spark, block):
    """Long runs over many blocks, gaps at their borders, blocks without rows, and one row alone."""
    rng = random.Random(block)
    frames = {1: [f for f in range(300) if rng.random() < 0.9], 2: [0, 1, 2, 6, 7, 8, 63, 64, 65, 127, 131, 400], 3: [64], 4: list(range(200))}
    rows = [(v, f, *[rng.uniform(0, 99) for _ in range(4)], rng.random()) for v, fs in frames.items() for f in fs]
    df = spark.createDataFrame(rows, ROW + ", score double")
    for f in (lambda b: tube.ema(df, 0.3, b), lambda b: tube.fill_gaps(df, 3, b), lambda b: tube.segments(df, b), lambda b: tube.drop_short(df, 4, b), lambda b: tube.drop_short(df, 9, b)):
        got, want = (sorted(tuple(r[c] for c in sorted(r.asDict())) for r in f(b).collect()) for b in (block, 1000))
        assert len(got) == len(want) and all(g == pytest.approx(w, abs=1e-9) for g, w in zip(got, want))
    for v, fs in frames.items():
        runs = [[fs[0]]]
        for a, b in zip(fs, fs[1:]):
            runs.append([b]) if b - a > 1 else runs[-1].append(b)
        assert sorted(r.frame for r in tube.drop_short(df, 4, block).where(f"video_id = {v}").collect()) == [f for run in runs if len(run) >= 4 for f in run]
        want = sorted((f, i + 1, len(run)) for i, run in enumerate(runs) for f in run)
        assert sorted((r.frame, r.segment, r.segment_len) for r in tube.segments(df, block).where(f"video_id = {v}").collect()) == want


def test_one_long_video_is_many_tasks(spark):
    one = spark.range(100_000).selectExpr("0L AS video_id", "cast(id AS int) AS frame", *[f"cast(id % {k} AS double) AS {c}" for k, c in zip((3, 5, 7, 11), ("x1", "y1", "x2", "y2"))], "0.5D AS score")
    for df in (tube.ema(one, 0.6, 1000), tube.fill_gaps(one, 3, 1000), tube.segments(one, 1000)):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert sum(sizes) == 100_000 and max(sizes) < 50_000


def test_axis_of_many_vectors_is_that_of_an_svd(spark):
    import numpy as np
    from tubeql.operators import pca

    rng = np.random.default_rng(5)
    data = {k: rng.normal(size=(n, 6)) * [5, 1, 1, 2, 1, 1] + n for k, n in (("a", 900), ("b", 4), ("c", 1), (None, 40))}
    data["d"] = np.ones((7, 6)) * 3
    rows = [(k, row.tolist()) for k, x in data.items() for row in x] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(5)
    for held in (pca.HELD, 50):  # once with many flushes
        got = {r.k: r for r in pca.principal_axis(df, ["k"], "v", held).collect()}
        assert set(got) == set(data)
        for k, x in data.items():
            assert got[k].n == len(x)
            if k in ("c", "d"):
                assert (got[k].vec, got[k].explained) == ([1.0, 0, 0, 0, 0, 0], None)
                continue
            _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
            want = vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
            assert np.allclose(got[k].vec, want, atol=1e-9) and abs(got[k].explained - s[0] ** 2 / (s**2).sum()) < 1e-9
    assert pca.principal_axis(df.limit(0), ["k"], "v").count() == 0
