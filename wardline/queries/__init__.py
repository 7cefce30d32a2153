"""Every operator run over the driver tables, with equivalent SQL for checking."""

import importlib
import pkgutil

from wardline.queries.registry import ORACLES, QUERIES


def load() -> None:
    """Import every query module once, which fills the registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module != "registry":
            importlib.import_module(f"{__name__}.{module}")


__all__ = ["ORACLES", "QUERIES", "load"]
