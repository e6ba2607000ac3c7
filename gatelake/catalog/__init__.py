"""Queries over the driver tables, one module per operator family."""

from importlib import import_module

MODULES = ("gates", "text", "matching", "upkeep", "release", "files", "plans", "streams")


def load() -> None:
    for module in MODULES:
        import_module(f"gatelake.catalog.{module}")
