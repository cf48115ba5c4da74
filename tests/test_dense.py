"""Crowded frames and large grids: the same rows as the small forms, by other plans."""

import random

import pytest

from tubeql.operators import blobs, select

BOX = "video_id long, frame int, cand_id long, x1 double, y1 double, x2 double, y2 double, score double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0.0


def crowd(n, seed=1):
    """Boxes of sides from 1 to 300, powers of two among them, copies, equal scores, empty boxes, negative coordinates."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        side = rng.choice([1, 2, 4, 8, 16, 64, 100, 256, 300, rng.uniform(1, 50)])
        x, y = rng.choice([-64, 0, 32, rng.uniform(-50, 400)]), rng.choice([-8, 0, 16, rng.uniform(-50, 400)])
        rows.append((1 + i % 2, 0, i, float(x), float(y), float(x + side), float(y + side * rng.choice([0, 0.5, 1, 1, 1.7])), round(rng.random(), 1)))
    return rows


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.9])
def test_pairs_on_grids_are_all_pairs(spark, threshold):
    rows = crowd(240)
    got = {(r.cand_id, r.other_id): r.iou for r in select.overlapping_pairs(spark.createDataFrame(rows, BOX), ["video_id", "frame"], "cand_id", threshold).collect()}
    want = {(a[2], b[2]): iou(a[3:7], b[3:7]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0] and iou(a[3:7], b[3:7]) > threshold}
    assert want and got == pytest.approx(want)


def test_pairs_need_a_threshold(spark):
    with pytest.raises(ValueError):
        select.overlapping_pairs(spark.createDataFrame([], BOX), ["video_id"], "cand_id", 0.0)


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_dense_suppression_is_the_greedy_one(spark, threshold):
    df = spark.createDataFrame(crowd(300, 5), BOX)
    by_id = lambda f: sorted(tuple(r[c] for c in sorted(r.asDict())) for r in f(df, ["video_id", "frame"], "score", threshold, "cand_id").collect())
    assert by_id(select.nms_dense) == by_id(select.nms)
    none = df.where("false")
    assert select.nms_dense(none, ["video_id"], "score", threshold, "cand_id").collect() == []


@pytest.mark.parametrize("side", [1, 3, 8])
def test_blobs_across_tiles_are_those_of_the_whole_grid(spark, side):
    """Random cells, a spiral through all tiles, a diagonal through tiles' corners, negative coordinates."""
    rng = random.Random(side)
    cells = {(1, x, y): rng.random() for x in range(-12, 12) for y in range(-9, 9)}
    spiral = {(x, y) for k in range(0, 8, 2) for x in range(k, 17 - k) for y in (k, 16 - k)} | {(x, y) for k in range(0, 8, 2) for y in range(k, 17 - k) for x in (k, 16 - k)}
    cells |= {(2, x, y): 1.0 for x, y in spiral} | {(3, i, i): 0.9 for i in range(-9, 15)} | {(3, 20, 0): 0.7}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "tile long, gx int, gy int, sim double")
    out = lambda d: sorted((r.tile, r.gx1, r.gy1, r.gx2, r.gy2, r.n_patches, r.max_sim) for r in d.collect())
    got = blobs.blobs_tiled(df, ["tile"], 0.6, 1, side)
    assert out(got) == out(blobs.blobs(df, ["tile"], 0.6, 1))
    firsts = {(r.tile, r.blob.gy, r.blob.gx) for r in got.collect()}
    assert len(firsts) == got.count() and all(cells[t, x, y] >= 0.6 for t, y, x in firsts)
    assert blobs.blobs_tiled(df.where("false"), ["tile"], 0.6, 1, side).collect() == []


def test_crowds_are_folded_not_paired(spark, monkeypatch):
    """Boxes that nearly all overlap: far fewer than all pairs are made; a null key is a key."""
    rng, rows = random.Random(3), []
    for i in range(3000):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        rows.append((None if i % 2 else 1, 0, i, x, y, x + 40 + i % 30, y + 40 + i % 29, round(rng.random(), 2)))
    made, met = [], select._met
    monkeypatch.setattr(select, "_met", lambda *a: made.append(met(*a).count()) or met(*a))
    df = spark.createDataFrame(rows, BOX)
    by_id = lambda f: sorted(tuple(str(r[c]) for c in sorted(r.asDict())) for r in f(df, ["video_id", "frame"], "score", 0.3, "cand_id").collect())
    assert by_id(select.nms_dense) == by_id(select.nms)
    assert sum(made) < 10 * len(rows)


def test_pairs_find_their_cell_without_arithmetic(spark):
    """The cell of a pair's corner is told by flags of the two boxes, not worked out for each pair."""
    pairs = select.overlapping_pairs(spark.createDataFrame(crowd(20), BOX), ["video_id", "frame"], "cand_id", 0.3)
    join = next(x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert "_fx" in join and "pow" not in join.lower() and "floor" not in join.lower()


def test_crowds_meet_as_blocks(spark, monkeypatch):
    """The join of a crowd has a row a pair of blocks, not a row a pair of boxes; copies of a box are paired like others."""
    rng = random.Random(7)
    rows = [(1, i % 2, i, x, y, x + 40 + i % 5, y + 41, 0.5) for i in range(600) for x, y in [(rng.randrange(6) * 1.0, rng.randrange(6) * 1.0)]]
    want = {(a[1], a[2], b[2], iou(a[3:7], b[3:7])) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] == b[1] and iou(a[3:7], b[3:7]) > 0.3}
    for block in (select.BLOCK, 7):
        monkeypatch.setattr(select, "BLOCK", block)
        pairs = select.overlapping_pairs(spark.createDataFrame(rows, BOX), ["video_id", "frame"], "cand_id", 0.3)
        got = [(r.frame, r.cand_id, r.other_id, r.iou) for r in pairs.collect()]
        assert len(got) == len(want) > 80000 and set(got) == want
        node, joined = pairs._jdf.queryExecution().optimizedPlan(), 0
        while not node.nodeName().startswith("Join"):
            node = node.children().head()
        joined = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node).count()
        assert joined < len(want) / 10


def test_equal_ids_are_no_pair(spark):
    """As in the query's SQL: other ids only, also where two sizes share an id; a null key or id has no pairs."""
    rows = [(1, 0, 5, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 0, 5, 0.0, 0.0, 10.0, 17.0, 0.5), (1, 0, 6, 0.0, 0.0, 10.0, 17.0, 0.5), (1, 0, None, 0.0, 0.0, 10.0, 17.0, 0.5)]
    rows += [(None, 0, i, 0.0, 0.0, 10.0, 10.0, 0.5) for i in (7, 8)]
    got = select.overlapping_pairs(spark.createDataFrame(rows, BOX), ["video_id", "frame"], "cand_id", 0.3).collect()
    assert sorted((r.cand_id, r.other_id, round(r.iou, 6)) for r in got) == [(5, 6, round(100 / 170, 6)), (5, 6, 1.0)]


def test_quick_rounding_is_the_plain_one(spark):
    from pyspark.sql import functions as F

    from tubeql.queries import quick6

    values = [0.0, 1.0, 1 / 3, 0.1234565, 0.4999995, 0.9999995, 0.3000005, 0.30000049999999997, 5e-7] + [k / n for n in (64, 1000, 3125, 4199) for k in range(0, n, 7)] + [k / 2e6 for k in range(600001, 602001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(quick6("v") != F.round("v", 6)).count() == 0
