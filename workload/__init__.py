"""The registered queries, grouped by what they read."""

from importlib import import_module

MODULES = ("scoring", "images", "registry", "constraints", "evaluation", "release")


def load() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"workload.{name}")
