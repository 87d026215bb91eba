"""Named queries over the driver's tables, each with its SQL equivalent where one exists."""

from importlib import import_module

from flowspark.catalog.base import ORACLES, QUERIES

MODULES = ("sources", "cleaning", "profiles", "sampling", "evaluation", "selection", "planning", "learning",
           "augmentation", "streams")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"flowspark.catalog.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
