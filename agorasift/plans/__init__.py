"""Registered queries, grouped by the kind of work."""

from importlib import import_module

_GROUPS = ("ingest", "stream", "text", "days", "experiment", "labels", "scoring", "analysis", "topics", "checks")


def load_all() -> None:
    """Import every group, which registers its queries."""
    for group in _GROUPS:
        import_module(f"{__name__}.{group}")
