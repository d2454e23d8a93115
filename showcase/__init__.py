"""Registered queries: the library's operators on the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("curves", "bins", "pairs", "stats", "decide", "model", "lake", "layouts")


def all_queries() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        for key, value in importlib.import_module(f"showcase.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = value
    return out
