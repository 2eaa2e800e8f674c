"""Sections of settings: defaults that come back, validation, step trees."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(defaults: Mapping[str, Any], section: Mapping[str, Any] | None) -> dict[str, Any]:
    """Defaults with the section over them: a key that is taken out falls back, an explicit null stays."""
    return {**copy.deepcopy(dict(defaults)), **(section or {})}


def merged(defaults: Column, section: Column) -> Column:
    """``resolve`` for map columns."""
    section = F.coalesce(section, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(section, k)), section)


def load(text: str) -> dict[str, dict[str, Any]]:
    """Settings in YAML: nothing is no settings; the whole and each section must be mappings."""
    import yaml

    found = yaml.safe_load(text) or {}
    if not isinstance(found, dict) or any(not isinstance(v or {}, dict) for v in found.values()):
        raise ValueError("settings and their sections must be mappings")
    return {k: v or {} for k, v in found.items()}


def _whole(x: Any, least: int, name: str) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < least:
        raise ValueError(f"{name} must be a whole number from {least}")
    return x


def batch_settings(section: Mapping[str, Any] | None, backend: str) -> tuple[int, float]:
    """(largest batch, wait in seconds) of a model's settings file, ``None`` if there is none.

    One backend has a default for each key; the others want both keys if there is a file.
    """
    if section is None:
        return 1, 0.0
    if set(section) & {"timeout", "timeout_ms", "batch_timeout_ms"}:
        raise ValueError("max_batch_wait_ms has taken the place of timeout settings")
    if "profile_index" in section:
        raise ValueError("profile_index is an argument of the step, not a setting of the model")
    if backend != "tensorrt" and not {"max_batch_size", "max_batch_wait_ms"} <= set(section):
        raise ValueError("both max_batch_size and max_batch_wait_ms are needed")
    wait = section.get("max_batch_wait_ms", 0)
    if isinstance(wait, bool) or not isinstance(wait, (int, float)) or not 0 <= wait < float("inf"):
        raise ValueError("max_batch_wait_ms must be a number from 0")
    return _whole(section.get("max_batch_size", 1), 1, "max_batch_size"), wait / 1000


def walk(step: Any, seen: set[int] | None = None) -> list[Any]:
    """A step and all that it wraps, each once, depth first."""
    seen = set() if seen is None else seen
    if id(step) in seen:
        return []
    seen.add(id(step))
    inner = [*getattr(step, "steps", ()), *([step.step] if getattr(step, "step", None) is not None else [])]
    return [step, *(x for child in inner for x in walk(child, seen))]
