"""Prototypes: reference views to one vector a video, and its refinement by a video's own best candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.box import center_box
from .pca import principal_axis

FUSIONS = ("mean", "max", "pca")


def masks(refs: DataFrame, low: float = 0.03, high: float = 0.92, ratio: float = 0.7) -> DataFrame:
    """refs with plausible, the mask box used instead if it isn't (centred, of `ratio` of each side), and the weight.

    An all-ones mask has ratio 1 and so is never plausible.
    """
    plausible = (F.col("mask_ratio") >= low) & (F.col("mask_ratio") <= high)
    c = center_box(F.col("width"), F.col("height"), ratio)
    share = (c.x2 - c.x1) * (c.y2 - c.y1) / (F.col("width") * F.col("height"))
    used = F.when(plausible, F.col("mask_ratio")).otherwise(share)
    sides = [F.when(~plausible, v).alias(f"mask_{n}") for v, n in zip(c, ("x1", "y1", "x2", "y2"))]
    return refs.select("*", plausible.alias("plausible"), *sides, used.alias("used_ratio"), (used + 1e-4).alias("weight"))


def ref_means(views: DataFrame) -> DataFrame:
    """(video_id, ref_id, feature, mask_ratio): the mean over a reference's views, not of unit length."""
    mean = vec.elementwise(views, ["video_id", "ref_id"], "feature", "feature")
    ratio = views.groupBy("video_id", "ref_id").agg(F.max("mask_ratio").alias("mask_ratio"))
    return mean.join(ratio, ["video_id", "ref_id"])


def fuse(refs: DataFrame, fusion: str = "mean", normalize: bool = True) -> DataFrame:
    """(video_id, vec): mean (weighted by mask ratio), element-wise max (unweighted), or first principal axis."""
    if fusion == "mean":
        out = vec.elementwise(refs.withColumn("_w", F.col("mask_ratio") + 1e-4), ["video_id"], "feature", "vec", weight="_w")
    elif fusion == "max":
        out = vec.elementwise(refs, ["video_id"], "feature", "vec", "max")
    elif fusion == "pca":
        out = principal_axis(refs, ["video_id"], "feature").select("video_id", "vec")
    else:
        raise ValueError(f"fusion {fusion!r} is not one of {FUSIONS}")
    return out.withColumn("vec", vec.normalize(F.col("vec"))) if normalize else out


def best_of(base: DataFrame, refined: DataFrame) -> DataFrame:
    """The refined prototype where there is one, else the base one; source tells which."""
    r = refined.select("video_id", F.col("vec").alias("_vec"))
    return base.join(r, "video_id", "left").select("video_id", F.coalesce("_vec", "vec").alias("vec"), F.when(F.col("_vec").isNotNull(), "dynamic").otherwise("base").alias("source"))


def homography(pitch_deg: float, yaw_deg: float, width: int, height: int) -> np.ndarray:
    """The 3 x 3 matrix of a camera turned by yaw and pitch, with focal length 1.2 times the longer side."""
    f, p, y = 1.2 * max(width, height), np.radians(pitch_deg), np.radians(yaw_deg)
    k = np.array([[f, 0, width / 2], [0, f, height / 2], [0, 0, 1.0]])
    rx = np.array([[1, 0, 0], [0, np.cos(p), -np.sin(p)], [0, np.sin(p), np.cos(p)]])
    ry = np.array([[np.cos(y), 0, np.sin(y)], [0, 1, 0], [-np.sin(y), 0, np.cos(y)]])
    return k @ ry @ rx @ np.linalg.inv(k)


def synthetic_views(refs: DataFrame, n: int, pitch: tuple[float, float], seed: int = 42) -> DataFrame:
    """refs with n views each: view_id, pitch, yaw (pseudo-random from seed, ref_id and view) and the matrix."""
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("ref_id"), F.col("view_id")), F.lit(1_000_003)) / 1_000_003
    views = refs.withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("pitch", pitch[0] + unit("p") * (pitch[1] - pitch[0])).withColumn("yaw", unit("y") * 30 - 15)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["matrix"] = [homography(a, b, w, h).ravel().tolist() for a, b, w, h in zip(p["pitch"], p["yaw"], p["width"], p["height"])]
            yield p

    return views.mapInPandas(run, views.schema.simpleString()[7:-1] + ",matrix:array<double>")
