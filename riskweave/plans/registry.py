"""All queries and SQL of the core, gathered from the modules of ``riskweave.plans``."""

from __future__ import annotations

import importlib
import pkgutil

import riskweave.plans as here


def gather(attr: str) -> dict:
    """The union of ``attr`` over the modules whose names end in ``_queries``; a name given twice is an error."""
    out: dict = {}
    for m in sorted(m.name for m in pkgutil.iter_modules(here.__path__) if m.name.endswith("_queries")):
        for k, v in getattr(importlib.import_module(f"{here.__name__}.{m}"), attr).items():
            if k in out:
                raise ValueError(f"query {k} is defined twice")
            out[k] = v
    return out
