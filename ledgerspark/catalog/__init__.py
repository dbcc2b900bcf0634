"""Registered queries, one module per area."""

from importlib import import_module

AREAS = ("billing", "portfolio", "profile", "quality", "evaluation", "credit", "models", "streams")


def load_all() -> None:
    for area in AREAS:
        import_module(f"ledgerspark.catalog.{area}")
