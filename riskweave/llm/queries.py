"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ["ranked", "frozen_sample", "segment_index", "mixing", "quality", "credentials", "leaks", "origin", "syntax"]

QUERIES: dict = {}
ORACLE: dict = {}
for _m in MODULES:
    _x = importlib.import_module(f"riskweave.llm.{_m}")
    QUERIES |= _x.QUERIES
    ORACLE |= _x.ORACLE
