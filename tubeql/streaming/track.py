"""The tracker's state machine over a stream of frames, keyed by video, with its state in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.box import COORDS
from ..operators.track import INPUT, OUTPUT, Rules, State, run


class TrackProcessor(StatefulProcessor):
    """Rows of a video must arrive in order of frames across batches; within a batch they are sorted.

    Expiry counts frames, not time, so no timers are needed.
    """

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("tracker", "active boolean, age int, since int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = State(*self.held.get()) if self.held.exists() else State()
        out = run(state, pd.concat(list(rows), ignore_index=True), self.rules)
        self.held.update((state.active, state.age, state.since))
        yield out

    def close(self) -> None:
        pass


def track_stream(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """As operators.track.track, for a streaming DataFrame. The session's state store must be RocksDB."""
    return rows.select(*INPUT).groupBy("video_id").transformWithStateInPandas(TrackProcessor(rules), OUTPUT, "Append", "None")


#: Numbers of a buffered row, the frame first; frames of one entry of the buffer.
NUMBERS = [c for c in INPUT if c != "video_id"]
BLOCK = 64


class OrderedTrackProcessor(StatefulProcessor):
    """Rows of a video may come in any order, as far apart as `lateness` frames.

    They wait in the state store, in blocks of frames, and a frame is released, in order, once one that is `lateness`
    frames later has come. What comes after its place was passed is given out as "late", without a box. A batch goes to
    the buffer chunk by chunk, and one block is in memory at a time. A video without rows for idle_ms is released whole
    (that needs a trigger that goes on: with timers of processing time Spark never calls a stream done).
    """

    def __init__(self, rules: Rules, lateness: int, idle_ms: int | None):
        self.rules, self.lateness, self.idle_ms = rules, lateness, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("tracker", "active boolean, age int, since int, top long, done long, timer long")
        self.sides = handle.getValueState("sides", "threshold double, vec array<double>")
        self.buffer = handle.getMapState("buffer", "block long", "rows array<array<double>>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        threshold, vec = row["threshold"], row.get("vec")
        self.sides.update((None if pd.isna(threshold) else float(threshold), None if vec is None else [float(x) for x in vec]))

    def _side(self) -> tuple[Rules, np.ndarray | None]:
        threshold, vec = self.sides.get() if self.sides.exists() else (None, None)
        return self.rules if threshold is None else replace(self.rules, threshold=threshold), None if vec is None else np.array(vec)

    def _keep(self, rows: pd.DataFrame, vec: np.ndarray | None) -> None:
        if "trk_feature" in rows and vec is not None:
            sims = [None if f is None else float(np.dot(f, vec)) for f in rows["trk_feature"]]
            rows = rows.assign(verify_sim=pd.Series(sims, index=rows.index, dtype=float))
        for block, own in rows.groupby(rows["frame"] // BLOCK, sort=False):
            key = (int(block),)
            before = list(self.buffer.getValue(key)[0]) if self.buffer.containsKey(key) else []
            new = [[None if x != x else float(x) for x in row] for row in own[NUMBERS].astype(float).to_numpy().tolist()]
            self.buffer.updateValue(key, ([*before, *new],))

    def _release(self, key, state: State, rules: Rules, bound: int | None) -> Iterator[pd.DataFrame]:
        for (block,) in sorted(tuple(k) for k in self.buffer.keys()):
            if bound is not None and block * BLOCK > bound:
                break
            rows = sorted(self.buffer.getValue((block,))[0], key=lambda r: r[0])
            ready = [r for r in rows if bound is None or r[0] <= bound]
            if len(ready) < len(rows):
                self.buffer.updateValue((block,), ([list(r) for r in rows[len(ready) :]],))
            else:
                self.buffer.removeKey((block,))
            if ready:
                yield run(state, pd.DataFrame(ready, columns=NUMBERS, dtype=float).assign(video_id=key[0]), rules)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, age, since, top, done, timer = self.held.get() if self.held.exists() else (False, 0, 0, None, None, None)
        state = State(active, age, since)
        rules, vec = self._side()
        for part in rows:
            late = part["frame"] <= done if done is not None else pd.Series(False, index=part.index)
            if late.any():
                gone = part.loc[late, ["video_id", "frame"]].assign(**{c: np.nan for c in COORDS}, source="late")
                yield gone.astype({"frame": "int32"})
            kept = part[~late]
            if len(kept):
                self._keep(kept, vec)
                top = max(int(kept["frame"].max()), kept["frame"].max() if top is None else top)
        if top is not None:
            bound = int(top) - self.lateness
            yield from self._release(key, state, rules, bound)
            done = bound if done is None else max(done, bound)
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.held.update((state.active, state.age, state.since, None if top is None else int(top), done, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        active, age, since, top, done, _ = self.held.get()
        state = State(active, age, since)
        yield from self._release(key, state, self._side()[0], None)
        self.held.update((state.active, state.age, state.since, top, top, None))

    def close(self) -> None:
        pass


def track_ordered(rows: DataFrame, rules: Rules = Rules(), lateness: int = 0, idle_ms: int | None = None, sides: DataFrame | None = None) -> DataFrame:
    """track_stream() for rows out of order; see OrderedTrackProcessor. Rows without a frame are left out.

    sides, (video_id, threshold double) and perhaps vec array<double>, a row a video, is the state that a video begins
    with: its own threshold, and its prototype, which a row's trk_feature (if rows have one) is compared with in place
    of verify_sim. Videos without a row there, or with nulls in it, have the threshold of the rules and their verify_sim.
    """
    wanted = [*INPUT, *(["trk_feature"] if "trk_feature" in rows.columns else [])]
    first = None if sides is None else sides.groupBy("video_id")
    kept = rows.where(F.col("frame").isNotNull()).select(*wanted)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return kept.groupBy("video_id").transformWithStateInPandas(OrderedTrackProcessor(rules, lateness, idle_ms), OUTPUT, "Append", mode, first)
