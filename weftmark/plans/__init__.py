"""Composed jobs and the query registry."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("table_queries", "detector_queries", "text_queries", "stream_queries")


def load_queries() -> None:
    """Import the modules that register queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
