"""The tracker's state machine, one video at a time in order of frames.

Input rows: (video_id, frame, det_x1.., trk_x1.., trk_conf, verify_sim, red_x1..): the best detection of a keyframe
that has one, the tracker's box and confidence, the similarity of the tracked crop, and what detecting on the frame
would give. Each may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.box import COORDS

INPUT = ["video_id", "frame", *[f"{p}_{c}" for p in ("det", "trk", "red") for c in COORDS], "trk_conf", "verify_sim"]
OUTPUT = "video_id long, frame int, x1 double, y1 double, x2 double, y2 double, source string"


@dataclass(frozen=True)
class Rules:
    confidence: float = 0.40
    max_age: int = 30
    verify_interval: int = 5
    threshold: float = 0.55
    tracker: bool = True  # False: every frame is detected on


@dataclass
class State:
    active: bool = False
    age: int = 0
    since: int = 0


def _box(row, prefix: str):
    x1 = row[f"{prefix}_x1"]
    return None if x1 is None or x1 != x1 else tuple(float(row[f"{prefix}_{c}"]) for c in COORDS)


def step(state: State, row, rules: Rules):
    """The box (or None) and its source for one frame; state moves on."""
    if not rules.tracker:
        red = _box(row, "red")
        return red, "detect" if red else "none"
    det = _box(row, "det")
    if det:
        state.active, state.age, state.since = True, 0, 0
        return det, "detect"
    if not state.active:
        return None, "none"
    state.age += 1
    state.since += 1
    box = _box(row, "trk")
    conf = row["trk_conf"]
    good = box is not None and conf is not None and conf >= rules.confidence and state.age <= rules.max_age
    if good and 0 < rules.verify_interval <= state.since:
        state.since, sim = 0, row["verify_sim"]
        good = sim is not None and sim >= rules.threshold
    if good:
        return box, "track"
    state.active = False
    red = _box(row, "red")
    if red:
        state.active, state.age, state.since = True, 0, 0
        return red, "detect"
    return None, "none"


def run(state: State, rows: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """One video's rows, in order of frames."""
    out = []
    for row in rows.sort_values("frame").to_dict("records"):
        box, source = step(state, row, rules)
        out.append((row["video_id"], row["frame"], *(box or (None,) * 4), source))
    return pd.DataFrame(out, columns=["video_id", "frame", *COORDS, "source"]).astype({"frame": "int32", **{c: "float64" for c in COORDS}})


def track(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Dense tracks: one row for each input row, box null where there is none.

    A video's rows are streamed through the state machine in batches of its sorted partition, not gathered.
    """

    def partition(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state = None, State()
        for part in parts:
            for v, own in part.groupby("video_id", sort=False):
                if v != video:
                    video, state = v, State()
                out = run(state, own, rules)
                out[list(COORDS)] = out[list(COORDS)].astype(object).where(out[list(COORDS)].notna(), None)
                yield out

    return rows.select(*INPUT).repartition("video_id").sortWithinPartitions("video_id", "frame").mapInPandas(partition, OUTPUT)


def coverage(tracks: DataFrame) -> DataFrame:
    """(video_id, n_frames, n_present, by source)."""
    sources = [F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("detect", "track", "none")]
    return tracks.groupBy("video_id").agg(F.count("*").alias("n_frames"), F.count("x1").alias("n_present"), *sources)
