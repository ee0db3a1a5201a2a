"""Composed flows and the catalog of checked queries."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module, which fills the catalog."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{info.name}")
