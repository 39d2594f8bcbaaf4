"""Queries by operator, over the fixture tables."""


def load():
    """The registry with all plans in it."""
    import importlib

    for name in ("scalars", "analytics", "sets", "search", "maintenance", "extract"):
        importlib.import_module(f"quern.plans.{name}")
    return importlib.import_module("quern.plans.registry")
