"""Named queries over the supplied tables."""

from importlib import import_module

MODULES = ("windows", "scalars", "sources", "joins", "graphs", "aggregates", "drift", "memory",
           "streams", "learned", "functions")


def load_all() -> None:
    """Import the modules that register queries, in the order of the inventory."""
    for m in MODULES:
        import_module(f"tidewatch.plans.{m}")
