"""Thresholds and weights, with defaults; one frozen value is passed to every operator."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Bands:
    """Inclusive upper bounds of the healthy, watch and warning bands."""

    healthy: int = 3072
    watch: int = 8000
    warning: int = 10000


@dataclass(frozen=True)
class Config:
    bands: Bands = field(default_factory=Bands)
    window_days: int = 180
    half_life_days: int = 180
    recency_days: int = 30
    late_days: int = 30
    maintainer_days: int = 90
    weights: tuple[float, float, float] = (0.6, 0.2, 0.2)
    candidate_limit: int | None = 500
    structural_tokens: tuple[int, int] = (300, 50000)
    shingle: int = 8
    step: int = 32
    min_similarity: float = 0.72
    max_pairs: int = 20
    max_edges: int = 10000
    max_commit_files: int = 200
    min_support: int = 3
    min_lift: float = 1.0
    source_test_mappings: tuple[tuple[str, str], ...] = ()
    top_terms: int = 25
    distinctive_terms: int = 5
    max_commits: int = 10000
    follow_renames: bool = False
    large_file_bytes: int = 2097152
    ignore_globs: tuple[str, ...] = ()
    data_min_bytes: int = 262144
    folder_tokens: tuple[int, int, int] = (31999, 128000, 256000)
    folder_files: tuple[int, int] = (17, 37)
    regression_delta: float = 5.0
    bots: tuple[str, ...] = ("[bot]", "dependabot", "renovate", "github-actions")

    def __post_init__(self) -> None:
        b = self.bands
        if not 0 < b.healthy < b.watch < b.warning:
            raise ValueError("bands must ascend")
        if abs(sum(self.weights) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")
        if not 0 < self.min_similarity <= 1 or self.shingle < 1 or self.step < 1:
            raise ValueError("similarity settings out of range")


#: Pointers of settings, by field; those of bands are below /bands.
GROUPS = {
    "history": ("window_days", "half_life_days", "recency_days", "late_days", "maintainer_days", "max_commits", "follow_renames", "bots"),
    "scoring": ("weights", "regression_delta"),
    "organization": ("candidate_limit", "structural_tokens", "shingle", "step", "min_similarity", "max_pairs", "max_edges", "max_commit_files", "min_support", "min_lift", "top_terms", "distinctive_terms"),
    "inventory": ("data_min_bytes", "large_file_bytes", "ignore_globs", "folder_tokens", "folder_files"),
    "verification": ("source_test_mappings",),
}
POINTERS = {f"/{group}/{name}": name for group, names in GROUPS.items() for name in names} | {f"/bands/{f.name}": f"bands.{f.name}" for f in fields(Bands)}


def fitted(value: object, like: object) -> object:
    """A JSON value in the type of a default; one of another type is an error."""
    if isinstance(like, tuple):
        if not isinstance(value, list) or like and len(like) != len(value) and not isinstance(like[0], str):
            raise ValueError(f"{value} is no list like {list(like)}")
        return tuple(tuple(v) if isinstance(v, list) else v for v in value)
    whole = isinstance(value, int) and not isinstance(value, bool)
    if isinstance(like, bool):
        right = isinstance(value, bool)
    elif isinstance(like, int):
        right = whole and value >= 0
    else:
        right = whole or isinstance(value, float)
    if not right:
        raise ValueError(f"{value!r} is not of the type of {like!r}")
    return type(like)(value)


def nested(pointer: str, value: object) -> dict:
    """An object that holds a value at a pointer."""
    for name in reversed(pointer.strip("/").split("/")):
        value = {name: value}
    return value


def configured(spark, text: str | None = None, sets: list[str] | tuple[str, ...] = ()) -> Config:
    """The settings of a JSON text, and of pointer=value pairs after it, over the defaults; unknown ones are an error."""
    from pyspark.sql import functions as F

    from gneiss.operators.settings import merged

    layers = [text] if text else []
    if text and not isinstance(json.loads(text), dict):
        raise ValueError("settings are an object")
    for pair in sets:
        pointer, _, value = pair.partition("=")
        layers.append(json.dumps(nested(pointer, json.loads(value))))
    if not layers:
        return Config()
    rows = merged(spark.createDataFrame([("", i, x) for i, x in enumerate(layers)], "owner string, layer long, config string"))
    cfg, bands = Config(), {}
    changes: dict = {}
    for r in rows.select("pointer", F.to_json("value").alias("value")).collect():
        if r["pointer"] not in POINTERS:
            if json.loads(r["value"]) == {} and any(p.startswith(r["pointer"] + "/") for p in POINTERS):
                continue
            raise ValueError(f"unknown setting {r['pointer']}")
        name, value = POINTERS[r["pointer"]], json.loads(r["value"])
        if name.startswith("bands."):
            bands[name[6:]] = fitted(value, getattr(cfg.bands, name[6:]))
        else:
            changes[name] = fitted(value, getattr(cfg, name))
    return replace(cfg, bands=replace(cfg.bands, **bands), **changes)
