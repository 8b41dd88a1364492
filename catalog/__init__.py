"""Queries over the driver's tables, each with its SQL check where SQL can express it."""

from importlib import import_module

MODULES = ["reports", "features", "anomaly", "scalars", "statements", "imports", "detectors", "ml", "streams", "state"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"catalog.{name}")
