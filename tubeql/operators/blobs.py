"""Blobs of similar patches: 8-connected components of a thresholded grid, as boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.box import from_patches
from .shared import settle


def components(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """For each cell the least index of its 8-connected component; indexes move along neighbours until none moves."""
    at = {(x, y): i for i, (x, y) in enumerate(zip(gx.tolist(), gy.tolist()))}
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) > (0, 0)]
    pairs = [(i, at[x + dx, y + dy]) for (x, y), i in at.items() for dx, dy in steps if (x + dx, y + dy) in at]
    label = np.arange(len(gx))
    if pairs:
        a, b = np.array(pairs).T
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    return label


def blobs(patches: DataFrame, keys: list[str], threshold: float, min_patches: int = 2) -> DataFrame:
    """(keys, blob, gx1, gy1, gx2, gy2, n_patches, max_sim) for each component of cells at threshold or above.

    A grid (one key) is bounded by its image; the rest of the plan is relational.
    """
    cells = patches.where(F.col("sim") >= threshold).select(*keys, "gx", "gy", "sim")

    def flood(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["gy", "gx"], ignore_index=True)
        return rows.assign(blob=components(rows["gx"].to_numpy(), rows["gy"].to_numpy()).astype("int32"))

    labelled = cells.groupBy(*keys).applyInPandas(flood, cells.schema.simpleString()[7:-1] + ",blob:int")
    found = labelled.groupBy(*keys, "blob").agg(F.min("gx").alias("gx1"), F.min("gy").alias("gy1"), F.max("gx").alias("gx2"), F.max("gy").alias("gy2"), F.count("*").alias("n_patches"), F.max("sim").alias("max_sim"))
    return found.where(F.col("n_patches") >= min_patches)


def joined_labels(links: DataFrame) -> DataFrame:
    """(a, l): the least node l that the links (a, b) connect a with. Each round takes the least label of a's neighbours
    and then that label's own label, so distances halve; rounds end when nothing moves."""
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = both.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("l"))
    while True:
        near = both.join(now.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("_near"))
        lower = now.join(near, "a").select("a", F.col("l").alias("_was"), F.least("l", "_near").alias("l"))
        after = settle(lower.join(now.select(F.col("a").alias("l"), F.col("l").alias("_up")), "l").select("a", "_was", F.least("l", "_up").alias("l")))
        if after.where(F.col("l") != F.col("_was")).isEmpty():
            return after.select("a", "l")
        now = after


def blobs_tiled(patches: DataFrame, keys: list[str], threshold: float, min_patches: int = 2, side: int = 512) -> DataFrame:
    """blobs() for grids of any size; blob is the component's first cell (gy, gx).

    Components are labelled inside tiles of side x side cells, a tile a task at most. Cells at the seams link labels of
    neighbouring tiles, and only labels at seams are joined further; a component's boxes, one a tile, are then merged.
    """
    if side < 1:
        raise ValueError("side must be at least 1")
    tile = [F.floor(F.col(c) / side).cast("long").alias("_t" + c[1]) for c in ("gx", "gy")]
    cells = patches.where(F.col("sim") >= threshold).select(*keys, "gx", "gy", "sim", *tile)

    def flood(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["gy", "gx"], ignore_index=True)
        first = components(rows["gx"].to_numpy(), rows["gy"].to_numpy())
        return rows.assign(_ly=rows["gy"].to_numpy()[first], _lx=rows["gx"].to_numpy()[first])

    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{c}` {k}" for c, k in [*cells.dtypes, ("_ly", kinds["gy"]), ("_lx", kinds["gx"])])
    labelled = settle(cells.groupBy(*keys, "_tx", "_ty").applyInPandas(flood, schema).withColumn("_label", F.struct(*keys, F.col("_ly").alias("gy"), F.col("_lx").alias("gx"))))
    edge = lambda c: F.pmod(F.col(c), F.lit(side)).isin(0, side - 1)
    seam = labelled.where(edge("gx") | edge("gy")).select(*keys, "gx", "gy", "_tx", "_ty", "_label")
    ahead = F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    asked = seam.select(*keys, F.col("_label").alias("a"), F.col("_tx").alias("_ax"), F.col("_ty").alias("_ay"), F.inline(ahead))
    links = asked.join(seam, [*keys, "gx", "gy"]).where((F.col("_ax") != F.col("_tx")) | (F.col("_ay") != F.col("_ty"))).select("a", F.col("_label").alias("b")).distinct()
    roots = joined_labels(links).withColumnRenamed("a", "_label")
    parts = labelled.groupBy("_label").agg(F.min("gx").alias("gx1"), F.min("gy").alias("gy1"), F.max("gx").alias("gx2"), F.max("gy").alias("gy2"), F.count("*").alias("n_patches"), F.max("sim").alias("max_sim"))
    whole = parts.join(roots, "_label", "left").groupBy(F.coalesce("l", "_label").alias("_root"))
    found = whole.agg(F.min("gx1").alias("gx1"), F.min("gy1").alias("gy1"), F.max("gx2").alias("gx2"), F.max("gy2").alias("gy2"), F.sum("n_patches").alias("n_patches"), F.max("max_sim").alias("max_sim"))
    blob = F.struct("_root.gy", "_root.gx").alias("blob")
    return found.where(F.col("n_patches") >= min_patches).select(*[F.col(f"_root.{k}").alias(k) for k in keys], blob, "gx1", "gy1", "gx2", "gy2", "n_patches", "max_sim")


def blob_boxes(found: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, patch: int = 14) -> DataFrame:
    """found with pixel boxes; the score is the best similarity. dx and dy, if there, are a tile's origin."""
    offset = [F.col(c) if c in found.columns else F.lit(0.0) for c in ("dx", "dy")]
    b = from_patches(F.col("gx1"), F.col("gy1"), F.col("gx2"), F.col("gy2"), F.lit(scale_x), F.lit(scale_y), *offset, patch=patch)
    return found.select("*", *[v.cast("double").alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"))], F.col("max_sim").alias("score"))
