import random

import pytest
from pyspark.sql import functions as F

from tubeql.functions import box as bx
from tubeql.operators import select, tiles

BOX = "x1 double, y1 double, x2 double, y2 double"


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def test_iou_closed_forms(spark):
    rows = [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (5, 5, 15, 15), 25 / 175), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0), ((5, 5, 1, 1), (0, 0, 9, 9), 0.0)]
    df = spark.createDataFrame([(*map(float, a), *map(float, b), e) for a, b, e in rows], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double, e double")
    assert all(abs(r.i - r.e) < 1e-12 for r in df.select(bx.iou(bx.box("a"), bx.box("b")).alias("i"), "e").collect())


def test_convert_refuses_unknown_formats():
    with pytest.raises(ValueError):
        bx.convert(bx.Box(1, 2, 3, 4), "xyxy", "ltrb", None, None)


def test_round_half_to_even(spark):
    df = spark.createDataFrame([(0.5, 1.5, 2.5, -0.5)], BOX)
    assert tuple(df.select(*bx.rounded(bx.box()).named()).first()) == (0, 2, 2, 0)


def plain_nms(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(plain_iou(r[2:6], k[2:6]) <= t for k in kept):
            kept.append(r)
    return [r[1] for r in kept]


def test_nms_golden_and_properties(spark):
    rng = random.Random(1)
    rows = [(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 1.0, 1.0, 11.0, 11.0, 0.8), (0, 2, 100.0, 100.0, 200.0, 200.0, 0.7)]
    for k in range(1, 60):
        for i in range(rng.randint(1, 25)):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            rows.append((k, i, x, y, x + rng.uniform(1, 30), y + rng.uniform(1, 30), rng.choice([0.1, 0.5, rng.random()])))
    df = spark.createDataFrame(rows, f"k long, i long, {BOX}, score double")
    once = select.nms(df, ["k"], "score", 0.5, "i")
    found = {}
    for r in once.orderBy("k", "_nms_rank").collect():
        found.setdefault(r.k, []).append(r.i)
    assert found[0] == [0, 2]
    for k in found:
        assert found[k] == plain_nms([r for r in rows if r[0] == k], 0.5)
    again = select.nms(once.drop("_nms_rank"), ["k"], "score", 0.5, "i")
    assert again.count() == once.count()
    assert select.overlapping_pairs(once, ["k"], "i", 0.5).count() == 0


def test_ties_fall_to_the_smaller_id(spark):
    df = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 4, 0.4)], "k long, i long, s double")
    assert [r.i for r in select.top_k(df, ["k"], "s", 1, "i").collect()] == [3]
    assert select.first_max(df, ["k"], "s", "i").first().i == 3
    assert select.top_k(df, ["k"], "s", None, "i").count() == 3


@pytest.mark.parametrize("overlap", [0.0, 0.25, 0.6])
def test_tiles_cover_every_pixel(spark, overlap):
    sizes = [(w, h) for w in (50, 64, 65, 200, 333) for h in (30, 64, 190)]
    got = tiles.tile_frames(spark.createDataFrame(sizes, "width int, height int"), (64, 48), overlap).collect()
    for w, h in sizes:
        own = [r for r in got if (r.width, r.height) == (w, h)]
        for axis, side, t in ((("tx1", "tx2"), w, 64), (("ty1", "ty2"), h, 48)):
            spans = sorted({(r[axis[0]], r[axis[1]]) for r in own})
            assert spans[0][0] == 0 and spans[-1][1] == side and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
            assert all(z - a == min(t, side) for a, z in spans)


def test_keyframes_of_odd_intervals(spark):
    df = spark.range(5).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("frame"))
    assert [tiles.keyframes(df, n).count() for n in (1, 2, 0, -1)] == [5, 3, 0, 0]
    assert df.limit(1).select(tiles.keyframe_sequence(F.lit(0), 2).alias("k")).first().k == []
