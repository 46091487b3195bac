"""Named queries: each builds its input from the given tables and applies library operators."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES, QueryFn

MODULES = ("build", "reporting", "quality", "forecasting", "scenarios", "sources", "landed")


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
