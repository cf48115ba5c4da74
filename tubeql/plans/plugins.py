"""Models as plug-ins: registries, the Arrow-batched calls, and deterministic stubs.

A model is built once in a worker, by name, when its first batch comes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Proposals(Protocol):
    def propose(self, payload: bytes, width: int, height: int) -> list[tuple[float, float, float, float, float]]: ...


class Features(Protocol):
    dim: int

    def extract(self, payloads: list[bytes]) -> np.ndarray: ...


class Pixels(Protocol):
    def view(self, payload: bytes, spec: str) -> bytes: ...


class Segmenter(Protocol):
    def mask(self, payload: bytes, width: int, height: int) -> np.ndarray: ...


class Tracker(Protocol):
    def init(self, payload: bytes, box: tuple[float, float, float, float]) -> None: ...

    def update(self, payload: bytes) -> tuple[tuple[float, float, float, float] | None, float]: ...


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big"))


class StubProposals:
    """n boxes inside the image that depend on the payload only."""

    def __init__(self, n: int = 5):
        self.n = n

    def propose(self, payload, width, height):
        r = _rng(payload, width, height)
        x, y = r.uniform(0, width, (self.n, 2)), r.uniform(0, height, (self.n, 2))
        x.sort(axis=1)
        y.sort(axis=1)
        return [(a[0], b[0], a[1], b[1], s) for a, b, s in zip(x, y, r.uniform(0, 1, self.n))]


class StubFeatures:
    """A unit vector that depends on the payload only."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def extract(self, payloads):
        out = np.stack([_rng(p).normal(size=self.dim) for p in payloads]) if payloads else np.zeros((0, self.dim))
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)).astype(np.float32)


    def grid(self, payload, width, height, patch=14):
        """Vectors of the image's patches, and how many pixels one pixel of the grid's image is wide and high."""
        rows, columns = max(1, height // patch), max(1, width // patch)
        out = _rng(payload, "grid").normal(size=(rows, columns, self.dim))
        return out / np.maximum(np.linalg.norm(out, axis=2, keepdims=True), 1e-8), width / (columns * patch), height / (rows * patch)


class DescribedPixels:
    """A view is its image's payload with the description after it."""

    def view(self, payload, spec):
        return bytes(payload) + spec.encode()


class Ensemble:
    """Two extractors' vectors as one of unit length."""

    def __init__(self, a: Features, b: Features):
        self.a, self.b, self.dim = a, b, a.dim + b.dim

    def extract(self, payloads):
        out = np.concatenate([self.a.extract(payloads), self.b.extract(payloads)], axis=1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


class PassThrough:
    """The whole image."""

    def mask(self, payload, width, height):
        return np.ones((height, width), dtype=bool)


class ConstantVelocity:
    """Moves the box by its last step; confidence is a constant."""

    def __init__(self, dx: float = 0.0, dy: float = 0.0, confidence: float = 0.9):
        self.step, self.confidence, self.box = (dx, dy, dx, dy), confidence, None

    def init(self, payload, box):
        self.box = box

    def update(self, payload):
        if self.box is None:
            return None, 0.0
        self.box = tuple(a + d for a, d in zip(self.box, self.step))
        return self.box, self.confidence


class NoTracker:
    """Every frame is detected on."""

    def init(self, payload, box):
        pass

    def update(self, payload):
        return None, 0.0


REGISTRY: dict[str, dict[str, Callable]] = {
    "proposals": {"stub": StubProposals},
    "features": {"stub": StubFeatures, "ensemble": lambda: Ensemble(StubFeatures(32), StubFeatures(32))},
    "pixels": {"stub": DescribedPixels},
    "segmenter": {"passthrough": PassThrough},
    "tracker": {"constant": ConstantVelocity, "none": NoTracker},
}


def register(kind: str, name: str, make: Callable) -> None:
    REGISTRY[kind][name] = make


def maker(kind: str, name: str) -> Callable:
    """What makes a model of that name; plans send it to the workers, where the registry is another one."""
    known = REGISTRY[kind]
    if name not in known:
        raise ValueError(f"{kind} model {name!r} is not one of {sorted(known)}")
    return known[name]


_made: dict[tuple[str, str], object] = {}


def made(kind: str, name: str, make: Callable):
    """A worker's one model of that name."""
    if (kind, name) not in _made:
        _made[kind, name] = make()
    return _made[kind, name]


def build(kind: str, name: str):
    return made(kind, name, maker(kind, name))


def propose(frames: DataFrame, name: str = "stub") -> DataFrame:
    """A row for each box of each row of frames (which has payload, width, height); prop_id numbers a row's boxes."""
    rest = [c for c in frames.columns if c != "payload"]
    kinds = ",".join(f"{n}:{t}" for n, t in frames.dtypes if n != "payload")
    make = maker("proposals", name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made("proposals", name, make)
        for p in parts:
            rows = [(*r, k, *b) for r, payload, w, h in zip(p[rest].itertuples(index=False), p["payload"], p["width"], p["height"]) for k, b in enumerate(model.propose(payload, w, h))]
            yield pd.DataFrame(rows, columns=[*rest, "prop_id", "x1", "y1", "x2", "y2", "score"])

    return frames.mapInPandas(run, f"{kinds},prop_id:long,x1:double,y1:double,x2:double,y2:double,score:double")


def embed(crops: DataFrame, name: str = "stub") -> DataFrame:
    """crops with feature in place of payload, a batch at a time."""
    kinds = ",".join(f"{n}:{t}" for n, t in crops.dtypes if n != "payload")
    make = maker("features", name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made("features", name, make)
        for p in parts:
            yield p.drop(columns="payload").assign(feature=[v.tolist() for v in model.extract(list(p["payload"]))])

    return crops.mapInPandas(run, f"{kinds},feature:array<float>")


def render(rows: DataFrame, name: str = "stub") -> DataFrame:
    """rows with the payload that `spec` describes in place of payload and spec."""
    kept = [c for c in rows.columns if c not in ("payload", "spec")]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("payload", T.BinaryType())])
    make = maker("pixels", name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made("pixels", name, make)
        for p in parts:
            yield p[kept].assign(payload=[model.view(a, b) for a, b in zip(p["payload"], p["spec"])])

    return rows.mapInPandas(run, schema)


def segment(images: DataFrame, name: str = "passthrough") -> DataFrame:
    """images (payload, width, height) with mask_ratio, the share of their pixels in the model's mask."""
    schema = T.StructType([*images.schema.fields, T.StructField("mask_ratio", T.DoubleType())])
    make = maker("segmenter", name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made("segmenter", name, make)
        for p in parts:
            yield p.assign(mask_ratio=[float(np.mean(model.mask(a, w, h))) for a, w, h in zip(p["payload"], p["width"], p["height"])])

    return images.mapInPandas(run, schema)


def grid(images: DataFrame, name: str = "stub") -> DataFrame:
    """A row for each patch of each image: gx, gy, feature, and the image's sx, sy."""
    kept = [c for c in images.columns if c != "payload"]
    kinds = [("gx", T.IntegerType()), ("gy", T.IntegerType()), ("sx", T.DoubleType()), ("sy", T.DoubleType()), ("feature", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*[images.schema[c] for c in kept], *[T.StructField(n, k) for n, k in kinds]])
    make = maker("features", name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made("features", name, make)
        for p in parts:
            for row in p.to_dict("records"):
                found, sx, sy = model.grid(row["payload"], row["width"], row["height"])
                at = [(x, y, sx, sy, found[y, x].tolist()) for y in range(found.shape[0]) for x in range(found.shape[1])]
                yield pd.DataFrame([(*[row[c] for c in kept], *v) for v in at], columns=[*kept, *[n for n, _ in kinds]])

    return images.mapInPandas(run, schema)
