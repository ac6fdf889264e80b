"""Queries over the given tables, with the SQL they are checked against."""

from importlib import import_module

MODULES = ["prompts", "library", "media", "lyrics", "maintenance", "scan"]


def load() -> None:
    for name in MODULES:
        import_module(f"workload.{name}")
