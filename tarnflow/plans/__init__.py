"""Pipelines, settings, and the registered queries."""

from __future__ import annotations

from tarnflow.plans.registry import ORACLES, QUERIES, Query


def _load() -> None:
    from tarnflow.plans import flagship, report_queries, stream_queries, vision_queries  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
