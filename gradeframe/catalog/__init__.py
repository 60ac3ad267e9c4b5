"""Queries over the shared test tables, each with its SQL twin where one exists."""

from importlib import import_module

MODULES = ["cleaning", "weathering", "keys", "profiling", "learning"]


def load():
    """Import every query module; return the queries and the SQL twins by name."""
    from gradeframe.catalog import registry

    for name in MODULES:
        import_module(f"gradeframe.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
