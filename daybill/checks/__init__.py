"""Registered queries, each with the SQL that states the same result for another engine."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import CHECKS, check  # noqa: F401


def load() -> dict:
    """Import every module of this package that registers checks."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "registry"):
        importlib.import_module(f"{__name__}.{module}")
    return CHECKS
