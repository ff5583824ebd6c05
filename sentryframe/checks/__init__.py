"""The registered queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ("hunting", "measuring", "evaluating", "ingesting")


def load_catalogue():
    """Import every query module and return the registry they filled."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
