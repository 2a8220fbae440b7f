"""Named queries: each pairs an operator of the library with its SQL counterpart."""

import importlib
import pkgutil


def all_queries():
    """Import every module of this package and return the filled registry."""
    from lorekeep.plans.registry import QUERIES

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES
