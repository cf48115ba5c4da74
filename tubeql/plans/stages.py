"""Stage tables: each stage's rows as Parquet, under the digest of all that they depend on.

A stage's key is the digest of its settings, its plug-ins (name and code), and its inputs: the keys of the stages before
it, and for tables from outside their content. A version of a stage is a folder of its own. What makes it count is a
manifest, a file that is written under another name and renamed, once the rows are there, to a number above all others.
A reader takes the version of the highest number when it begins, so two runs at once leave whole versions of which one
is in force, a run that dies leaves none, and readers of an older version aren't disturbed.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prototype
from . import composite, models, plugins
from .config import Config

_C, _M = ("candidates", "references"), ("candidates", "references", "matching")
#: The settings that each stage's table depends on, in order.
SECTIONS = {"references": _C, "prototypes": _C, "candidates": _C, "thresholds": _M, "refined": _M, "detections": _M, "tracks": (*_M, "tracking"), "tube": (*_M, "tracking", "tubes")}
#: The plug-ins that a stage asks, with the setting that names each.
PLUGINS = {
    "references": {"pixels": "project.pixels", "segmenter": "references.segmenter", "features": "candidates.features"},
    "candidates": {"pixels": "project.pixels", "proposals": "candidates.proposals", "features": "candidates.features"},
    "tracks": {"pixels": "project.pixels", "proposals": "candidates.proposals", "features": "candidates.features", "tracker": "tracking.tracker"},
}


def code_of(maker: Callable) -> str:
    """What tells one version of a plug-in from another: its `version`, if it has one, else its source, else its name."""
    version = getattr(maker, "version", None)
    if version is not None:
        return str(version)
    try:
        return inspect.getsource(maker)
    except (OSError, TypeError):
        return getattr(maker, "__qualname__", repr(maker))


def content(df: DataFrame) -> str:
    """A digest of the schema and of all rows, whatever their order: one pass, two sums of hashes a task."""
    row = [F.xxhash64(F.lit(k), *df.columns) for k in range(2)]
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    return json.dumps([df.schema.json(), *map(str, df.agg(F.count("*"), *map(total, row)).first())])


class Store:
    """Stage tables below one folder, local or remote."""

    def __init__(self, spark: SparkSession, config: Config, **inputs: DataFrame):
        """inputs: the tables from outside by name; what the stages make depends on their content."""
        self.spark, self.config = spark, config
        self.inputs = {name: content(df) for name, df in sorted(inputs.items())}

    def key(self, stage: str) -> str:
        settings = self.config.model_dump()
        asked = {}
        for name in list(SECTIONS)[: list(SECTIONS).index(stage) + 1]:
            for kind, place in PLUGINS.get(name, {}).items():
                section, field = place.split(".")
                if (chosen := settings[section].get(field)) is not None:
                    asked[f"{name}.{kind}"] = [chosen, code_of(plugins.maker(kind, chosen)) if chosen in plugins.REGISTRY[kind] else ""]
        whole = [stage, self.config.fingerprint(*SECTIONS[stage]), asked, self.inputs]
        return hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest()[:24]

    def path(self, stage: str) -> str:
        return f"{self.config.project.work_dir}/{stage}/{self.key(stage)}"

    def _file(self, name: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def manifests(self, stage: str) -> list[str]:
        """The names of the stage's manifests, the one in force last."""
        system, place = self._file(f"{self.path(stage)}/_manifests")
        found = [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []
        return sorted(x for x in found if not x.startswith((".", "_")))

    def current(self, stage: str) -> dict | None:
        """The manifest of the stage's version in force: folder, schema, inputs."""
        names = self.manifests(stage)
        if not names:
            return None
        system, place = self._file(f"{self.path(stage)}/_manifests/{names[-1]}")
        stream = system.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def has(self, stage: str) -> bool:
        return bool(self.manifests(stage))

    def commit(self, stage: str, manifest: dict) -> None:
        """Puts a version in force by one rename to a name that nobody else takes."""
        folder, name = f"{self.path(stage)}/_manifests", uuid.uuid4().hex
        system, held = self._file(f"{folder}/.{name}")
        stream = system.create(held, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        number = 1 + int(self.manifests(stage)[-1].split("-")[0]) if self.has(stage) else 0
        if not system.rename(held, self._file(f"{folder}/{number:012d}-{name}")[1]):
            raise OSError(f"{folder}: the manifest can't be renamed")

    def table(self, stage: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        """The stage's rows: read if they are there, else made, written and made current."""
        now = None if force or not self.config.project.use_cache else self.current(stage)
        if now is None:
            rows = make()
            order = [c for c in ("video_id", "frame") if c in rows.columns]
            folder = f"{self.path(stage)}/{uuid.uuid4().hex}"
            rows.repartition("video_id").sortWithinPartitions(*order).write.partitionBy("video_id").parquet(folder)
            now = {"folder": folder, "schema": rows.schema.jsonValue(), "stage": stage, "inputs": self.inputs}
            self.commit(stage, now)
        schema = T.StructType.fromJson(now["schema"])
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        return self.spark.read.schema(loose).parquet(now["folder"]).select(*schema.names)


def run_all(spark: SparkSession, config: Config, candidates: DataFrame, refs: DataFrame, from_stage: str = "candidates", tracks_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates to tubes; stages from from_stage on are made anew. tracks_of: detections to tracks.

    Without tracks_of a frame's first detection is its track, which is what tracking without a tracker gives.
    """
    plain = lambda d: d.where("det_rank = 1").select("video_id", "frame", "x1", "y1", "x2", "y2", "score", "source")
    store, force = Store(spark, config, candidates=candidates, refs=refs), _force(from_stage)
    cands = store.table("candidates", lambda: candidates, force["candidates"] and from_stage != "candidates")
    dets, _, _ = matched(store, cands, refs, force)
    tracks = store.table("tracks", lambda: (tracks_of or plain)(dets), force["tracks"] and from_stage != "candidates")
    return store.table("tube", lambda: composite.final(tracks, config), force["tube"] and from_stage != "candidates")


def _force(from_stage: str | None) -> dict[str, bool]:
    order = list(SECTIONS)
    if from_stage is None:
        return dict.fromkeys(order, False)
    if from_stage not in order:
        raise ValueError(f"stage {from_stage!r} is not one of {order}")
    return {s: order.index(s) >= order.index(from_stage) for s in order}


def matched(store: Store, cands: DataFrame, refs: DataFrame, force: dict[str, bool]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stage 3's tables: detections, thresholds and refined prototypes, made together."""
    names = ("detections", "thresholds", "refined")
    made: list[DataFrame] = []

    def make(k: int) -> Callable[[], DataFrame]:
        def one() -> DataFrame:
            if not made:
                made.extend(composite.detections(cands, refs, store.config))
            return made[k]

        return one

    anew = force["detections"] and not force["candidates"]
    return tuple(store.table(name, make(k), anew) for k, name in enumerate(names))


def run_models(spark: SparkSession, config: Config, images: DataFrame, frames: DataFrame, from_stage: str | None = None) -> DataFrame:
    """Reference images (video_id, ref_id, payload, width, height) and frames (video_id, frame, payload, width, height)
    to tubes, each stage a table; stages from from_stage on are made anew."""
    store, force = Store(spark, config, images=images, frames=frames), _force(from_stage)
    refs = store.table("references", lambda: models.references(images, config), force["references"])
    protos = store.table("prototypes", lambda: models.prototypes(refs, config), force["prototypes"])
    cands = store.table("candidates", lambda: models.candidates(frames, protos, config), force["candidates"])
    dets, bars, refined = matched(store, cands, refs, {**force, "candidates": False})
    final = protos if config.matching.multi_reference else prototype.best_of(protos, refined.where("updated"))
    tracks = store.table("tracks", lambda: models.scored_tracks(models.tracks(frames, dets, bars, final, config, refs), dets), force["tracks"])
    return store.table("tube", lambda: composite.final(tracks, config), force["tube"])
