"""All queries of the core library with their SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib
import pkgutil

import tabulon.plans

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _info in sorted(pkgutil.iter_modules(tabulon.plans.__path__), key=lambda m: m.name):
    if _info.name.endswith("_queries"):
        _module = importlib.import_module(f"tabulon.plans.{_info.name}")
        QUERIES.update(_module.QUERIES)
        ORACLE.update(_module.ORACLE)
