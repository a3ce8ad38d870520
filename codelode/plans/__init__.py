"""Registered queries: each binds an operator to the given tables and names its oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil

from codelode.catalogue import CATALOGUE, Catalogue


def load_catalogue() -> Catalogue:
    for module in sorted(item.name for item in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return CATALOGUE
