"""Typed configuration: defaults, a YAML file, and dotted overrides, in this order.

Only settings that something reads are declared (tests/test_models.py holds them to that). Unlike a cache keyed by file names, stage tables are keyed by
fingerprint(), so a changed setting never meets an old table.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator


#: The defaults below, which results depend on.
class Section(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Project(Section):
    work_dir: str = "./runs"
    use_cache: bool = True
    pixels: str = "stub"


class References(Section):
    count: int = 3
    fusion: Literal["mean", "max", "pca"] = "mean"
    normalize: bool = True
    scales: list[float] = [1.0, 0.75, 0.5]
    mask_low: float = 0.03
    mask_high: float = 0.92
    center_ratio: float = 0.7
    segmenter: str = "passthrough"
    synthetic_views: int = 0
    pitch_range: list[float] = [40.0, 85.0]
    degrade: bool = True
    seed: int = 42


class Candidates(Section):
    keyframe_interval: int = 8
    tiled: bool = True
    tile: list[int] = [640, 640]
    overlap: float = 0.25
    scales: list[float] = [1.0]
    nms_iou: float = 0.5
    min_box_area: float = 16.0
    max_per_keyframe: int = 400
    crop_pad: float = 0.10
    proposals: str = "stub"
    features: str = "stub"
    dense: bool = False
    dense_trigger: int = 3
    dense_threshold: float = 0.12
    dense_min_patches: int = 2
    dense_max: int = 20


class Refinement(Section):
    enabled: bool = True
    rounds: int = 2
    alpha: float = 0.3
    percentile: float = 90
    floor: float = 0.15
    support: int = 2


class Matching(Section):
    similarity: Literal["cosine", "l1", "l2"] = "cosine"
    match_threshold: float = 0.55
    adaptive: bool = False
    adaptive_z: float = 2.0
    adaptive_floor: float = 0.05
    global_topk: int | None = None
    nms_iou: float = 0.5
    topk_per_keyframe: int = 5
    multi_reference: bool = False
    refinement: Refinement = Field(default_factory=Refinement)


class Tracking(Section):
    tracker: Literal["builtin", "model", "none"] = "builtin"
    model_path: str | None = None
    confidence: float = 0.40
    max_age: int = 30
    verify_interval: int = 5

    @model_validator(mode="after")
    def _needs_path(self):
        if self.tracker == "model" and not self.model_path:
            raise ValueError("tracking.tracker=model needs tracking.model_path")
        return self


class Tubes(Section):
    smooth: bool = True
    ema_alpha: float = 0.6
    fill_short_gaps: int = 3
    min_tube_length: int = 2

    @field_validator("ema_alpha")
    @classmethod
    def _share(cls, v: float) -> float:
        if not 0 < v <= 1:
            raise ValueError("tubes.ema_alpha must be above 0 and at most 1")
        return v


class Config(Section):
    project: Project = Field(default_factory=Project)
    references: References = Field(default_factory=References)
    candidates: Candidates = Field(default_factory=Candidates)
    matching: Matching = Field(default_factory=Matching)
    tracking: Tracking = Field(default_factory=Tracking)
    tubes: Tubes = Field(default_factory=Tubes)

    def fingerprint(self, *sections: str) -> str:
        """A digest of the named sections, or of all but project."""
        every = self.model_dump()
        chosen = {k: every[k] for k in (sections or [k for k in every if k != "project"])}
        return hashlib.sha256(json.dumps(chosen, sort_keys=True).encode()).hexdigest()[:16]


def merge(base: dict, over: dict) -> dict:
    """over's values on base's, key by key at every depth."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def coerce(text: str) -> Any:
    """true, false, null and ~, then a whole number, a number, a JSON list or object, else the text ("none" too)."""
    known = {"true": True, "false": False, "null": None, "~": None}
    if text.lower() in known:
        return known[text.lower()]
    kinds: list = [int, float]
    if text[:1] in ("[", "{"):
        kinds.append(json.loads)
    for kind in kinds:
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def override(text: str) -> dict:
    """The nested dict of "a.b.c=value"."""
    path, eq, value = text.partition("=")
    keys = path.split(".")
    if not eq or not all(k.replace("_", "a").isalnum() for k in keys):
        raise ValueError(f"override {text!r} is not dotted.key=value")
    out: Any = coerce(value)
    for k in reversed(keys):
        out = {k: out}
    return out


def load(path: str | None = None, overrides: list[str] | None = None) -> Config:
    data = yaml.safe_load(Path(path).read_text()) or {} if path else {}
    for x in overrides or []:
        data = merge(data, override(x))
    return Config.model_validate(data)
