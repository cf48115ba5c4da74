"""Pixels: sampling, blur, camera warps, crops and statistics of raw images, a batch of rows at a time.

An image is three columns: width, height and pixels, the bytes of its rows, three (red, green, blue) a pixel. Images are
worked on where their rows lie; nothing here shuffles. Rows of one size and one operation are one tensor operation.

Sampling is separable: a side's new pixels are a sparse matrix of weights over its old ones, so an image costs two small
matrix products. `linear` samples between pixel centres and repeats the border; `area` is the mean of what a new pixel
covers. `warp` samples a projective camera's source points between four pixels and repeats the border. Results are
rounded to whole numbers, halves to the even one.

Defined results
* null width, height or pixels, or pixels of another length than width * height * 3: null pixels (statistics are null).
* a crop that is empty gives an image of 32 x 32 black pixels; boxes are cut to the image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of pixels that are made into one tensor at most.
TENSOR = 32 << 20
EMPTY = (32, 32)


@lru_cache(maxsize=256)
def linear_weights(old: int, new: int) -> np.ndarray:
    """new x old: each new pixel's centre lies between two old ones."""
    at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
    low = np.floor(at).astype(int)
    part = at - low
    out = np.zeros((new, old))
    out[np.arange(new), low] += 1 - part
    out[np.arange(new), np.minimum(low + 1, old - 1)] += part
    return out


@lru_cache(maxsize=256)
def area_weights(old: int, new: int) -> np.ndarray:
    """new x old: how much of a new pixel each old one covers."""
    edges = np.arange(new + 1) * old / new
    over = np.minimum(edges[1:, None], np.arange(1, old + 1)) - np.maximum(edges[:-1, None], np.arange(old))
    return np.maximum(over, 0) * new / old


@lru_cache(maxsize=256)
def blur_weights(size: int, window: int) -> np.ndarray:
    """size x size: a Gaussian over an odd window, mirrored at the border without repeating it."""
    half = window // 2
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(window) - half) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    out = np.zeros((size, size))
    for k, w in enumerate(kernel):
        at = np.abs(np.arange(size) + k - half)
        span = max(2 * (size - 1), 1)
        at = at % span
        out[np.arange(size), np.where(at >= size, span - at, at)] += w
    return out


def weighted(images: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """images (n, height, width, channels) with the weights of both sides applied, rounded."""
    tall = np.tensordot(images.astype(np.float64), rows, axes=(1, 1))  # n, width, channels, new height
    wide = np.tensordot(tall, columns, axes=(1, 1))  # n, channels, new height, new width
    return np.clip(np.rint(wide.transpose(0, 2, 3, 1)), 0, 255).astype(np.uint8)


def resized(images: np.ndarray, width: int, height: int, how: str = "linear") -> np.ndarray:
    weights = {"linear": linear_weights, "area": area_weights}[how]
    return weighted(images, weights(images.shape[1], height), weights(images.shape[2], width))


def blurred(images: np.ndarray, window: int) -> np.ndarray:
    return weighted(images, blur_weights(images.shape[1], window | 1), blur_weights(images.shape[2], window | 1))


def degraded(images: np.ndarray, factor: float, window: int) -> np.ndarray:
    """As seen from afar: made smaller and larger again, then blurred."""
    height, width = images.shape[1:3]
    if factor < 1:
        images = resized(resized(images, max(1, round(width * factor)), max(1, round(height * factor)), "area"), width, height)
    return blurred(images, window) if window > 0 else images


def warped(images: np.ndarray, matrices: np.ndarray) -> np.ndarray:
    """images under projective maps (n, 3, 3) from their own points to the result's, sampled backwards."""
    n, height, width, _ = images.shape
    y, x = np.mgrid[0:height, 0:width]
    points = np.linalg.inv(matrices) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    w = np.where(points[:, 2] == 0, np.inf, points[:, 2])
    sx, sy = np.clip(points[:, 0] / w, 0, width - 1), np.clip(points[:, 1] / w, 0, height - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, width - 1), np.minimum(y0 + 1, height - 1)
    fx, fy, each = (sx - x0)[..., None], (sy - y0)[..., None], np.arange(n)[:, None]
    at = lambda yy, xx: images[each, yy, xx].astype(np.float64)
    top, low = at(y0, x0) * (1 - fx) + at(y0, x1) * fx, at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8).reshape(images.shape)


#: What an operation makes of images of one size and the rows' settings: images of one size.
Operation = Callable[[np.ndarray, list[tuple]], np.ndarray]


def tensors(sizes: list[tuple | None]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, row numbers): rows of one key, TENSOR bytes at a time; key begins with width and height."""
    by: dict[tuple, list[int]] = {}
    for k, key in enumerate(sizes):
        if key is not None:
            by.setdefault(key, []).append(k)
    for key, rows in by.items():
        step = max(1, TENSOR // max(1, key[0] * key[1] * 3))
        for at in range(0, len(rows), step):
            yield key, np.array(rows[at : at + step])


def stacked(pixels: list[bytes], rows: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.frombuffer(b"".join(pixels[k] for k in rows), dtype=np.uint8).reshape(len(rows), height, width, 3)


def readable(pixels: list, widths: list, heights: list) -> list[bool]:
    return [p is not None and w is not None and h is not None and w > 0 and h > 0 and len(p) == 3 * w * h for p, w, h in zip(pixels, widths, heights)]


def applied(images: DataFrame, operation: Operation, same: list[str] = (), each: list[str] = ()) -> DataFrame:
    """images with width, height and pixels as the operation makes them. Rows of equal size and equal columns `same`
    are handed over together, with each row's values of `same` and `each`."""
    names = images.columns
    schema = T.StructType([f if f.name not in ("width", "height", "pixels") else T.StructField(f.name, T.BinaryType() if f.name == "pixels" else T.IntegerType()) for f in images.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(names, b.columns))
            pixels, widths, heights = (columns[c].to_pylist() for c in ("pixels", "width", "height"))
            shared, own = [columns[c].to_pylist() for c in same], [columns[c].to_pylist() for c in each]
            frozen = lambda v: tuple(v) if isinstance(v, list) else v
            good = readable(pixels, widths, heights)
            keys = [(w, h, *(frozen(c[k]) for c in shared)) if ok else None for k, (ok, w, h) in enumerate(zip(good, widths, heights))]
            out: list[bytes | None] = [None] * len(pixels)
            for (w, h, *_), rows in tensors(keys):
                made = operation(stacked(pixels, rows, w, h), [(*(c[k] for c in shared), *(c[k] for c in own)) for k in rows])
                for k, image in zip(rows, made):
                    out[k], heights[k], widths[k] = image.tobytes(), image.shape[0], image.shape[1]
            new = {"pixels": pa.array(out, pa.binary()), "width": pa.array(widths, pa.int32()), "height": pa.array(heights, pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(c, columns[c]) for c in names], names=names)

    return images.mapInArrow(run, schema)


def resize(images: DataFrame, how: str = "linear") -> DataFrame:
    """images at the size of their columns new_width and new_height."""
    return applied(images, lambda x, s: resized(x, *s[0], how), same=["new_width", "new_height"])


def pyramid(images: DataFrame, scales: list[float]) -> DataFrame:
    """Every image at every scale: with columns level and scale, the sides rounded down, one pixel at least."""
    level = images.select("*", F.posexplode(F.array(*[F.lit(float(s)) for s in scales])).alias("level", "scale"))
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * F.col("scale"))).cast("int")
    return resize(level.withColumns({"new_width": side("width"), "new_height": side("height")})).drop("new_width", "new_height")


def degrade(images: DataFrame, factor: float, window: int) -> DataFrame:
    return applied(images, lambda x, _: degraded(x, factor, window))


def warp(images: DataFrame, matrix: str = "matrix") -> DataFrame:
    """images under the nine numbers, by rows, of their column `matrix`."""
    return applied(images, lambda x, s: warped(x, np.array([m for (m,) in s], dtype=np.float64).reshape(-1, 3, 3)), each=[matrix])


def crop(images: DataFrame, boxes: str = "boxes") -> DataFrame:
    """(columns but boxes, place, width, height, pixels): the boxes (x1, y1, x2, y2 in whole pixels) of each image's
    array column `boxes`, so that an image is read once whatever the number of its boxes."""
    kept = [c for c in images.columns if c not in (boxes, "width", "height", "pixels")]
    schema = T.StructType([*[images.schema[c] for c in kept], *T.StructType.fromDDL("place int, width int, height int, pixels binary")])

    def cut(image: np.ndarray, box: dict) -> np.ndarray:
        height, width = image.shape[:2]
        part = image[max(0, box["y1"]) : max(0, min(height, box["y2"])), max(0, box["x1"]) : max(0, min(width, box["x2"]))]
        return part if part.size else np.zeros((*EMPTY, 3), dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(images_columns, b.columns))
            pixels, widths, heights, wanted = (columns[c].to_pylist() for c in ("pixels", "width", "height", boxes))
            for k, ok in enumerate(readable(pixels, widths, heights)):
                places = wanted[k] or []
                if not places:
                    continue
                image = np.frombuffer(pixels[k], dtype=np.uint8).reshape(heights[k], widths[k], 3) if ok else None
                parts = [cut(image, x) if ok else None for x in places]
                n = len(parts)
                own = [columns[c].take(pa.array([k] * n)) for c in kept]
                sides = [pa.array([None if p is None else p.shape[s] for p in parts], pa.int32()) for s in (1, 0)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(n), pa.int32()), *sides, pa.array([None if p is None else p.tobytes() for p in parts], pa.binary())], names=schema.names)

    images_columns = images.columns
    return images.mapInArrow(run, schema)


def measured(images: DataFrame) -> DataFrame:
    """images with sums, the sum of each channel over all pixels, in place of pixels; nothing else is sent on."""
    kept = [c for c in images.columns if c != "pixels"]
    schema = T.StructType([*[images.schema[c] for c in kept], *T.StructType.fromDDL("sums array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(names, b.columns))
            pixels, widths, heights = (columns[c].to_pylist() for c in ("pixels", "width", "height"))
            sums = [np.frombuffer(p, dtype=np.uint8).reshape(-1, 3).sum(0, dtype=np.int64).tolist() if ok else None for p, ok in zip(pixels, readable(pixels, widths, heights))]
            yield pa.RecordBatch.from_arrays([*[columns[c] for c in kept], pa.array(sums, pa.list_(pa.int64()))], names=schema.names)

    names = images.columns
    return images.mapInArrow(run, schema)


def mean_color(sums: Column, width: Column, height: Column) -> Column:
    """The mean of each channel."""
    return F.transform(sums, lambda s: s / (width * height))


def painted(images: DataFrame, mask: str = "mask") -> DataFrame:
    """images whose pixels outside the runs of column `mask` have the image's mean colour, rounded down."""

    def paint(x: np.ndarray, settings: list[tuple]) -> np.ndarray:
        out = np.empty_like(x)
        for image, (runs,), result in zip(x, settings, out):
            flat = image.reshape(-1, 3)
            inside = np.zeros(len(flat) + 1, dtype=np.int64)
            for r in runs or []:
                inside[r["start"]] += 1
                inside[r["start"] + r["length"]] -= 1
            color = (flat.sum(0, dtype=np.int64) // len(flat)).astype(np.uint8)
            result[:] = np.where(np.cumsum(inside)[:-1, None] > 0, flat, color).reshape(image.shape)
        return out

    return applied(images, paint, each=[mask])


def segmented(images: DataFrame, levels: list[int]) -> DataFrame:
    """images with masks and scores: for each level the pixels whose brightness (red + green + blue) is above it, as
    runs, and how far the two sides' means lie apart, times the root of the product of their shares."""
    names = images.columns
    schema = T.StructType([*images.schema.fields, *T.StructType.fromDDL("masks array<array<struct<start:int,length:int>>>, scores array<double>")])

    def one(pixels: bytes) -> tuple[list, list[float]]:
        light = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, 3).sum(1, dtype=np.int64)
        masks, scores = [], []
        for level in levels:
            on = light > level
            edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
            masks.append([{"start": int(a), "length": int(z - a)} for a, z in zip(edge[::2], edge[1::2])])
            n = int(on.sum())
            apart = light[on].mean() - light[~on].mean() if 0 < n < len(on) else 0.0
            scores.append(float(apart * np.sqrt(n / len(on) * (1 - n / len(on)))))
        return masks, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
        for b in batches:
            columns = dict(zip(names, b.columns))
            pixels, widths, heights = (columns[c].to_pylist() for c in ("pixels", "width", "height"))
            found = [one(p) if ok else (None, None) for p, ok in zip(pixels, readable(pixels, widths, heights))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m for m, _ in found], kind), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=schema.names)

    return images.mapInArrow(run, schema)
