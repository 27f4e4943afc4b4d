"""Registered queries, grouped by topic. Importing a module registers its queries."""

from __future__ import annotations

import importlib

from swathline.plans.registry import ORACLES, QUERIES

MODULES = (
    "scans", "flood", "scenes", "scalars", "records", "series", "neighbourhood", "geometry", "vectors", "learning", "incremental",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"swathline.plans.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
