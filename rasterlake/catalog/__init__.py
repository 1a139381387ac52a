"""Registered queries over the test tables, with their DuckDB counterparts."""

from importlib import import_module

MODULES = (
    "pixel_queries", "tile_queries", "expression_queries", "metadata_queries", "job_queries", "audit_queries",
    "planning_queries", "stream_queries",
)


def all_queries():
    """The registry with every query module loaded."""
    for name in MODULES:
        import_module(f"rasterlake.catalog.{name}")
    return import_module("rasterlake.catalog.registry")
