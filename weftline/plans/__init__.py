"""All registered queries; importing the modules fills the registry."""

import importlib
import pkgutil

from .registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
    importlib.import_module(f"{__name__}.{_m}")
