"""Stages 1, 2 and 4 as the configuration says, with models as plug-ins.

Pixels are the business of a plug-in too: a view of an image is its payload and a description of what to cut, scale or
warp (JSON), which the `pixels` plug-in turns into a payload of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.box import COORDS, area, box, crop_rect, shift
from ..operators import blobs, match, prototype, select, tiles, track
from . import composite, plugins
from .config import Config

KEYS = ["video_id", "frame"]


def described(kind: str, **fields) -> Column:
    """The JSON description of a view."""
    return F.to_json(F.struct(F.lit(kind).alias("kind"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def reference_views(images: DataFrame, config: Config) -> DataFrame:
    """(video_id, ref_id, view_id, mask_ratio, payload) of the first `count` images (video_id, ref_id, payload, width,
    height) of each video: a view for each scale, and for each synthetic camera."""
    r = config.references
    masked = prototype.masks(plugins.segment(images.where(F.col("ref_id") < r.count), r.segmenter), r.mask_low, r.mask_high, r.center_ratio)
    region = F.struct("mask_x1", "mask_y1", "mask_x2", "mask_y2")
    rows = masked.drop("mask_ratio").withColumnRenamed("used_ratio", "mask_ratio").withColumn("region", region)
    columns = ["video_id", "ref_id", "view_id", "mask_ratio", "payload", "spec"]
    scales = F.posexplode(F.array(*[F.lit(float(s)) for s in r.scales])).alias("view_id", "scale")
    out = rows.select("*", scales).withColumn("spec", described("reference", scale=F.col("scale"), region=F.col("region"))).select(*columns)
    if r.synthetic_views:
        turned = prototype.synthetic_views(rows.select("video_id", "ref_id", "width", "height"), r.synthetic_views, tuple(r.pitch_range), r.seed).select("video_id", "ref_id", "view_id", "matrix")
        joined = rows.join(turned, ["video_id", "ref_id"]).withColumn("spec", described("camera", matrix=F.col("matrix"), region=F.col("region"), blur=r.degrade))
        out = out.unionByName(joined.withColumn("view_id", F.col("view_id") + len(r.scales)).select(*columns))
    return plugins.render(out, config.project.pixels)


def references(images: DataFrame, config: Config) -> DataFrame:
    """(video_id, ref_id, feature, mask_ratio): Stage 1's vectors, a row a reference."""
    return prototype.ref_means(plugins.embed(reference_views(images, config), config.candidates.features))


def prototypes(refs: DataFrame, config: Config) -> DataFrame:
    """(video_id, vec): Stage 1's result."""
    return prototype.fuse(refs, config.references.fusion, config.references.normalize)


def asked(frames: DataFrame, config: Config) -> DataFrame:
    """Keyframes in each scale and tile, rendered: what models are asked."""
    rows = composite.keyframe_frames(frames, config)
    c = config.candidates
    if c.tiled:
        spec = described("tile", scale=F.col("scale"), tile=F.struct("tx1", "ty1", "tx2", "ty2"))
        rows = rows.withColumns({"spec": spec, "width": F.col("tx2") - F.col("tx1"), "height": F.col("ty2") - F.col("ty1")})
    else:
        rows = rows.withColumns({"spec": described("frame", scale=F.col("scale")), "tile_id": F.lit(0), "tx1": F.lit(0), "ty1": F.lit(0)})
    return plugins.render(rows.select(*KEYS, "scale", "tile_id", "tx1", "ty1", "width", "height", "payload", "spec"), config.project.pixels)


def proposed(frames: DataFrame, config: Config) -> DataFrame:
    """A model's boxes of all scales and tiles of the keyframes, suppressed and capped; prop_id tells a frame's apart."""
    c = config.candidates
    raw = plugins.propose(asked(frames, config), c.proposals)
    place = F.array_position(F.array(*[F.lit(float(s)) for s in c.scales]), F.col("scale")) * 100_000 + F.col("tile_id")
    return composite.proposals(raw.withColumn("prop_id", place * 10_000 + F.col("prop_id")), c.tiled, c.nms_iou, c.min_box_area, c.max_per_keyframe)


def dense_boxes(frames: DataFrame, protos: DataFrame, config: Config) -> DataFrame:
    """(video_id, frame, cand_id, box, score): blobs of patches like the prototype; ids are negative.

    Tiled: suppressed across tiles. Then small boxes go and the best dense_max of a frame stay.
    """
    c = config.candidates
    one = config.model_copy(deep=True)
    one.candidates.scales = [1.0]
    patches = match.score(plugins.grid(asked(frames, one), c.features), protos, config.matching.similarity)
    keys = [*KEYS, "tile_id", "tx1", "ty1", "sx", "sy"]
    found = blobs.blobs(patches, keys, c.dense_threshold, c.dense_min_patches)
    scaled = blobs.blob_boxes(found)
    sides = {k: F.col(k) * F.col(s) for k, s in zip(COORDS, ("sx", "sy", "sx", "sy"))}
    moved = scaled.withColumns(sides)
    moved = moved.withColumns(dict(zip(COORDS, shift(box(), F.col("tx1"), F.col("ty1"))))).withColumn("cand_id", -(F.col("tile_id").cast("long") * 100_000 + F.col("blob") + 1))
    if c.tiled:
        moved = select.nms(moved.select(*KEYS, "cand_id", *COORDS, "score"), KEYS, "score", 0.5, "cand_id").drop("_nms_rank")
    return select.top_k(moved.where(area(box()) >= c.min_box_area), KEYS, "score", c.dense_max, "cand_id").select(*KEYS, "cand_id", *COORDS, "score")


def candidates(frames: DataFrame, protos: DataFrame, config: Config) -> DataFrame:
    """Stage 2: candidates of the keyframes with the features of their padded crops."""
    c = config.candidates
    keys = tiles.keyframes(frames, c.keyframe_interval)
    dense = dense_boxes(frames, protos, config) if c.dense else None
    found = composite.candidates(proposed(frames, config), dense, keys if c.dense else None, c.nms_iou, c.max_per_keyframe, c.dense_trigger, c.dense_max)
    crops = found.join(keys.select(*KEYS, "width", "height", "payload"), KEYS)
    spec = described("crop", box=F.struct(*crop_rect(box(), F.col("width"), F.col("height"), c.crop_pad).named()))
    return plugins.embed(plugins.render(crops.withColumn("spec", spec).drop("width", "height"), config.project.pixels), c.features)


def suppressed(boxes: list[tuple], limit: float) -> list[tuple]:
    """One frame's boxes, best first, without those that overlap a better one by more than limit; ties in their order."""
    order = sorted(boxes, key=lambda b: -b[4])
    x1, y1, x2, y2, _ = np.array(order, dtype=float).reshape(-1, 5).T
    size, left = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0), np.ones(len(order), dtype=bool)
    for i in range(len(order)):
        if left[i]:
            meet = np.maximum(np.minimum(x2, x2[i]) - np.maximum(x1, x1[i]), 0) * np.maximum(np.minimum(y2, y2[i]) - np.maximum(y1, y1[i]), 0)
            union = size + size[i] - meet
            left[i + 1 :] &= ~(meet > limit * union)[i + 1 :]
    return [b for b, stays in zip(order, left) if stays]


class FrameRow:
    """One frame for the state machine; what a model has to tell is asked only when it is needed."""

    def __init__(self, row: dict, models: dict, rules: track.Rules, config: Config):
        self.row, self.models, self.rules, self.config, self.known = row, models, rules, config, {}

    def view(self, kind: str, **fields) -> bytes:
        """Of the frame, described as described() does."""
        return self.models["pixels"].view(self.row["payload"], json.dumps({"kind": kind, **fields}, separators=(",", ":")))

    def crop(self, sides) -> bytes:
        """A box's padded crop, as crop_rect() has it."""
        x1, y1, x2, y2 = sides
        px, py = (x2 - x1) * self.config.candidates.crop_pad, (y2 - y1) * self.config.candidates.crop_pad
        low, high = (max(0, int(x1 - px)), max(0, int(y1 - py))), (min(self.row["width"], int(x2 + px)), min(self.row["height"], int(y2 + py)))
        return self.view("crop", box=dict(zip(COORDS, map(int, (*low, *high)))))

    def similarities(self, boxes: list) -> np.ndarray | None:
        """Of the boxes' crops, embedded in one call, with the prototype, or the mean over the references; None without these."""
        vecs = self.row["vecs"]
        if vecs is None:
            return None
        a, b = np.asarray(self.models["features"].extract([self.crop(x) for x in boxes]), dtype=float), np.stack([np.asarray(v, dtype=float) for v in vecs])
        how = self.config.matching.similarity
        if how == "cosine":
            return (a @ b.T).mean(axis=1)
        apart = a[:, None, :] - b[None, :, :]
        return -(np.sqrt((apart**2).sum(axis=2)) if how == "l2" else np.abs(apart).sum(axis=2)).mean(axis=1)

    def proposed(self) -> list:
        """The model's boxes of the frame, or of its tiles with the doubles suppressed; small ones go, the rest is capped."""
        c, propose = self.config.candidates, self.models["proposals"].propose
        if self.row["tiles"] is None:
            found = propose(self.view("frame", scale=1.0), self.row["width"], self.row["height"])
        else:
            found = []
            for t in self.row["tiles"]:
                sides = {k: int(t[k]) for k in ("tx1", "ty1", "tx2", "ty2")}
                x, y = sides["tx1"], sides["ty1"]
                own = propose(self.view("tile", scale=1.0, tile=sides), sides["tx2"] - x, sides["ty2"] - y)
                found += [(b[0] + x, b[1] + y, b[2] + x, b[3] + y, b[4]) for b in own]
            found = suppressed(found, 0.5)
        return [b[:4] for b in found if max(0, b[2] - b[0]) * max(0, b[3] - b[1]) >= c.min_box_area][: c.max_per_keyframe]

    def ask(self, what: str):
        if what == "trk":
            return self.models["tracker"].update(self.row["payload"])
        if what == "red":
            found = self.proposed()
            sims = self.similarities(found) if found else None
            return None if sims is None or sims.max() < self.rules.threshold else found[int(sims.argmax())]
        moved = self[("trk",)][0]
        sims = None if moved is None else self.similarities([moved])
        return None if sims is None else float(sims[0])

    def __getitem__(self, key):
        if isinstance(key, tuple):
            return self.known[key[0]] if key[0] in self.known else self.known.setdefault(key[0], self.ask(key[0]))
        if key == "verify_sim":
            return self[("verify",)]
        if key == "trk_conf":
            return self[("trk",)][1]
        kind, _, side = key.partition("_")
        if kind == "det":
            return self.row[key]
        sides = self[("trk",)][0] if kind == "trk" else self[("red",)]
        return None if sides is None else sides[COORDS.index(side)]


def tracks(frames: DataFrame, detections: DataFrame, bars: DataFrame, protos: DataFrame, config: Config, refs: DataFrame | None = None) -> DataFrame:
    """Stage 4: every frame's box and source. Detections begin a track, the tracker carries it on, its crop is compared
    with the prototype every verify_interval frames, and a lost object is looked for on the frame itself.

    bars: (video_id, threshold), protos: (video_id, vec); videos without a threshold take the fixed one. With
    matching.multi_reference and refs (video_id, ref_id, feature) a crop's similarity is the mean over the references.
    A video without a vector is detected and tracked by what there is, but nothing is found again on its frames.
    """
    c, t, fixed = config.candidates, config.tracking, config.matching.match_threshold
    best = detections.where("det_rank = 1").select(*KEYS, *[F.col(c).alias(f"det_{c}") for c in COORDS])
    multi = config.matching.multi_reference and refs is not None
    vectors = match.ref_list(refs).select("video_id", "vecs") if multi else protos.select("video_id", F.array("vec").alias("vecs"))
    own = match.effective(frames, bars, fixed).join(vectors, "video_id", "left")
    parts = tiles.tiles(F.col("width"), F.col("height"), tuple(c.tile), c.overlap) if c.tiled else F.lit(None).cast("array<int>")
    rows = frames.select(*KEYS, "width", "height", "payload", parts.alias("tiles")).join(best, KEYS, "left").join(own, "video_id")
    name = {"builtin": "constant", "none": "none"}.get(t.tracker, t.model_path)
    kind = dict(frames.dtypes)["video_id"]
    shared = [(k, n, plugins.maker(k, n)) for k, n in (("features", config.candidates.features), ("proposals", config.candidates.proposals), ("pixels", config.project.pixels))]
    tracker = plugins.maker("tracker", name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {k: plugins.made(k, n, make) for k, n, make in shared}
        video, state, models = None, track.State(), {}
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                if row["video_id"] != video:
                    video, state, models = row["video_id"], track.State(), {**kept, "tracker": tracker()}
                rules = track.Rules(t.confidence, t.max_age, t.verify_interval, row["threshold"], t.tracker != "none")
                sides, source = track.step(state, FrameRow(row, models, rules, config), rules)
                if source == "detect":
                    models["tracker"].init(row["payload"], sides)
                out.append((video, row["frame"], *(sides or (None,) * 4), source))
            yield pd.DataFrame(out, columns=[*KEYS, *COORDS, "source"]).astype({c: "object" for c in COORDS})

    return rows.repartition("video_id").sortWithinPartitions(*KEYS).mapInPandas(run, f"video_id {kind}, frame int, x1 double, y1 double, x2 double, y2 double, source string")


def scored_tracks(found: DataFrame, detections: DataFrame) -> DataFrame:
    """Tracks with a score: that of the frame's first detection, else 0."""
    best = detections.where("det_rank = 1").select(*KEYS, "score")
    return found.join(best, KEYS, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def report(per_video: DataFrame) -> DataFrame:
    """(video_id, st_iou) by video, as text, the mean last: what a run prints."""
    lines = per_video.select(F.lit(0).alias("place"), "video_id", F.concat(F.col("video_id").cast("string"), F.lit(": "), F.format_number("st_iou", 4)).alias("line"))
    mean = per_video.agg(F.concat(F.lit("mean ST-IoU: "), F.format_number(F.coalesce(F.avg("st_iou"), F.lit(0.0)), 4), F.lit(" over "), F.count("*").cast("string")).alias("line"))
    return lines.unionByName(mean.select(F.lit(1).alias("place"), F.lit(None).cast(lines.schema["video_id"].dataType).alias("video_id"), "line")).orderBy("place", "video_id").select("line")
