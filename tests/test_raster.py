"""Masks and rasters against NumPy, pixel by pixel."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tubeql.functions import mask as mk
from tubeql.operators import prototype, raster

SCHEMA = "id int, width int, height int, pixels binary"


def image(rng, w, h):
    return rng.integers(0, 256, (h, w, 3), dtype=np.uint8)


def rows(images):
    return [(k, x.shape[1], x.shape[0], x.tobytes()) for k, x in enumerate(images)]


def arrays(df):
    return {r["id"]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3) for r in df.collect()}


def flags_of(runs, size):
    out = np.zeros(size, dtype=bool)
    for r in runs:
        assert not out[r["start"] : r["start"] + r["length"]].any()
        out[r["start"] : r["start"] + r["length"]] = True
    return out


def is_canonical(runs):
    return all(r["length"] > 0 for r in runs) and all(a["start"] + a["length"] < b["start"] for a, b in zip(runs, runs[1:]))


def test_masks_equal_arrays_of_pixels(spark):
    rng = random.Random(1)
    cases = []
    for k in range(60):
        w, h = rng.randint(1, 9), rng.randint(1, 8)
        p = rng.choice([0, 0.1, 0.5, 0.9, 1])
        a, b = ([rng.random() < p for _ in range(w * h)] for _ in range(2))
        cases.append((k, w, h, a, b))
    df = spark.createDataFrame(cases, "k int, w int, h int, a array<boolean>, b array<boolean>")
    df = df.withColumns({"ma": mk.of_flags(F.col("a")), "mb": mk.of_flags(F.col("b"))})
    w, h, a, b = (F.col(c) for c in ("w", "h", "ma", "mb"))
    out = df.select("*", mk.area(a).alias("area"), mk.share(a, w, h).alias("share"), mk.bounds(a, w).alias("box"), mk.both(a, b).alias("both"), mk.either(a, b).alias("either"), mk.without(a, w * h).alias("rest"), mk.iou(a, b).alias("iou"))
    for r in out.collect():
        x, y = np.array(r["a"]), np.array(r["b"])
        assert all(is_canonical(r[c]) for c in ("ma", "mb", "both", "either", "rest"))
        assert (flags_of(r["ma"], x.size) == x).all() and r["area"] == x.sum() and r["share"] == x.mean()
        assert (flags_of(r["both"], x.size) == (x & y)).all() and (flags_of(r["either"], x.size) == (x | y)).all() and (flags_of(r["rest"], x.size) == ~x).all()
        assert r["iou"] == pytest.approx((x & y).sum() / max(1, (x | y).sum()))
        ys, xs = np.nonzero(x.reshape(r["h"], r["w"]))
        assert (tuple(r["box"]) if r["box"] else None) == ((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1) if x.any() else None)


def test_boxes_best_masks_and_the_fallback(spark):
    df = spark.createDataFrame([(10, 6)], "w int, h int")
    w, h = F.col("w"), F.col("h")
    box = lambda *c: mk.of_box(*map(F.lit, c), w)
    r = df.select(box(2, 1, 5, 3).alias("a"), box(-3, 0, 99, 2).alias("b"), box(4, 4, 4, 6).alias("c"), mk.center(w, h, 0.5).alias("d"), mk.plausible(box(0, 0, 1, 1), w, h, 0.03, 0.92, 0.75).alias("e"), mk.plausible(box(2, 1, 5, 3), w, h, 0.03, 0.92, 0.75).alias("f")).first()
    runs = lambda c: [tuple(x) for x in r[c]]
    assert runs("a") == [(12, 3), (22, 3)] == runs("f") and runs("b") == [(0, 20)] and runs("c") == [] and runs("d") == [(12, 5), (22, 5), (32, 5)]
    assert runs("e") == [(11 + 10 * k, 7) for k in range(4)]
    masks = F.array(box(0, 0, 1, 1), box(0, 0, 2, 1), box(0, 0, 3, 1))
    best = df.select(*[mk.area(mk.best(masks, F.array(*map(F.lit, s)))).alias(str(k)) for k, s in enumerate([(0.1, 0.9, 0.9), (0.5, 0.4, 0.3), (0.1, 0.2, 0.3)])]).first()
    assert tuple(best) == (2, 1, 3)
    assert df.select(mk.best(F.expr(f"cast(array() as array<{mk.TYPE}>)"), F.expr("cast(array() as array<double>)")).alias("x")).first().x is None


def loop_resize(x, w, h):
    """Bilinear sampling at pixel centres, a pixel at a time."""
    out = np.zeros((h, w, 3), dtype=np.uint8)
    for j in range(h):
        for i in range(w):
            sx, sy = (min(max((k + 0.5) * o / n - 0.5, 0), o - 1) for k, o, n in ((i, x.shape[1], w), (j, x.shape[0], h)))
            x0, y0 = int(sx), int(sy)
            x1, y1, fx, fy = min(x0 + 1, x.shape[1] - 1), min(y0 + 1, x.shape[0] - 1), sx - int(sx), sy - int(sy)
            p = x.astype(float)
            out[j, i] = np.rint((p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy)
    return out


def close(a, b, by=1):
    assert a.shape == b.shape and np.abs(a.astype(int) - b.astype(int)).max() <= by  # halves may round either way


def test_pyramid_against_a_loop(spark):
    rng = np.random.default_rng(2)
    images = [image(rng, 8, 6), image(rng, 5, 7), image(rng, 1, 1), image(rng, 8, 6)]
    got = raster.pyramid(spark.createDataFrame(rows(images), SCHEMA), [1.0, 0.75, 0.5]).collect()
    assert len(got) == 12
    for r in got:
        x = images[r["id"]]
        h, w = x.shape[:2]
        size = max(1, int(w * r["scale"])), max(1, int(h * r["scale"]))
        assert (r["width"], r["height"]) == size
        out = np.frombuffer(r["pixels"], np.uint8).reshape(size[1], size[0], 3)
        close(out, loop_resize(x, *size))
        if r["scale"] == 1.0:
            assert (out == x).all()


def test_area_and_blur_and_degrade(spark):
    rng = np.random.default_rng(3)
    x = image(rng, 8, 4)
    half = raster.resized(x[None], 4, 2, "area")[0]
    close(half, x.reshape(2, 2, 4, 2, 3).mean(axis=(1, 3)).round())
    flat = np.full((1, 9, 7, 3), 77, dtype=np.uint8)
    assert (raster.blurred(flat, 5) == flat).all() and (raster.degraded(flat, 0.3, 5) == flat).all()
    dot = np.zeros((1, 9, 9, 3), dtype=np.uint8)
    dot[0, 4, 4] = 255
    kernel = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 1.1**2))
    kernel /= kernel.sum()
    close(raster.blurred(dot, 5)[0, 2:7, 2:7, 0], np.rint(255 * np.outer(kernel, kernel)))
    got = arrays(raster.degrade(spark.createDataFrame(rows([x, x]), SCHEMA), 0.5, 3))
    assert (got[0] == got[1]).all() and got[0].shape == x.shape and (got[0] == raster.degraded(x[None], 0.5, 3)[0]).all()


def test_warps_by_known_matrices(spark):
    rng = np.random.default_rng(4)
    x = image(rng, 7, 5)
    shift = [1, 0, 2, 0, 1, 1, 0, 0, 1]  # right by 2, down by 1
    turn = [-1, 0, 6, 0, -1, 4, 0, 0, 1]  # half a turn
    matrices = [np.eye(3).ravel().tolist(), [float(v) for v in shift], [float(v) for v in turn], prototype.homography(40, 0, 7, 5).ravel().tolist()]
    df = spark.createDataFrame([(k, 7, 5, x.tobytes(), m) for k, m in enumerate(matrices)], SCHEMA + ", matrix array<double>")
    got = arrays(raster.warp(df))
    assert (got[0] == x).all() and (got[2] == x[::-1, ::-1]).all()
    assert (got[1] == x[np.clip(np.arange(5) - 1, 0, 4)][:, np.clip(np.arange(7) - 2, 0, 6)]).all()
    inverse, want = np.linalg.inv(np.array(matrices[3]).reshape(3, 3)), np.zeros_like(x)
    for j in range(5):
        for i in range(7):
            sx, sy, w = inverse @ [i, j, 1]
            sx, sy = min(max(sx / w, 0), 6), min(max(sy / w, 0), 4)
            x0, y0 = int(sx), int(sy)
            x1, y1, fx, fy = min(x0 + 1, 6), min(y0 + 1, 4), sx - x0, sy - y0
            p = x.astype(float)
            want[j, i] = np.rint((p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy)
    close(got[3], want)


def test_crops_means_paint_and_segments(spark):
    rng = np.random.default_rng(5)
    images = [image(rng, 6, 4), image(rng, 3, 3)]
    df = spark.createDataFrame([(*r, [(0, 0, 2, 2), (-1, 1, 99, 3), (5, 5, 9, 9)] if r[0] == 0 else []) for r in rows(images)], SCHEMA + ", boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    cut = {r["place"]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3) for r in raster.crop(df).collect()}
    assert (cut[0] == images[0][:2, :2]).all() and (cut[1] == images[0][1:3]).all() and cut[2].shape == (32, 32, 3) and not cut[2].any() and len(cut) == 3
    plain = spark.createDataFrame(rows(images), SCHEMA)
    for r in raster.measured(plain).select("*", raster.mean_color(F.col("sums"), F.col("width"), F.col("height")).alias("mean")).collect():
        assert np.allclose(r["mean"], images[r["id"]].reshape(-1, 3).mean(0))
    found = raster.segmented(plain, [200, 380, 600])
    got = arrays(raster.painted(found.withColumn("mask", mk.best(F.col("masks"), F.col("scores")))))
    for r in found.collect():
        x = images[r["id"]]
        light, scores = x.sum(2, dtype=int).ravel(), []
        for level, runs in zip([200, 380, 600], r["masks"]):
            on = light > level
            assert (flags_of(runs, light.size) == on).all() and is_canonical(runs)
            n = on.sum()
            scores.append((light[on].mean() - light[~on].mean()) * math.sqrt(n * (light.size - n)) / light.size if 0 < n < light.size else 0)
        assert np.allclose(scores, r["scores"])
        on = light > [200, 380, 600][int(np.argmax(scores))]
        color = x.reshape(-1, 3).mean(0).astype(np.uint8)
        assert (got[r["id"]] == np.where(on[:, None], x.reshape(-1, 3), color).reshape(x.shape)).all()


def test_nulls_and_broken_rows(spark):
    bad = [(0, None, 2, b"abc"), (1, 2, 2, b"abc"), (2, 2, 2, None), (3, 0, 0, b"")]
    df = spark.createDataFrame([(*r, [(0, 0, 1, 1)], [float(k % 4 == 0) for k in range(9)], None) for r in bad], SCHEMA + f", boxes array<struct<x1:int,y1:int,x2:int,y2:int>>, matrix array<double>, mask {mk.TYPE}")
    for out in (raster.warp(df), raster.degrade(df, 0.5, 3), raster.painted(df), raster.crop(df), raster.pyramid(df, [0.5])):
        assert [r["pixels"] for r in out.collect()] == [None] * 4
    assert [r["sums"] for r in raster.measured(df).collect()] == [None] * 4
    empty = df.limit(0)
    assert raster.warp(empty).count() == raster.crop(empty).count() == raster.segmented(empty, [1]).count() == 0
