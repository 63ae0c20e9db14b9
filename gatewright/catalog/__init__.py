"""All named queries."""

from importlib import import_module
from pkgutil import iter_modules

from gatewright.catalog.registry import REGISTRY


def registered() -> dict:
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
    return REGISTRY
