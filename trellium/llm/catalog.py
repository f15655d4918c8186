"""All queries of the subpackage, and their SQL."""

from __future__ import annotations

import importlib

_PROBLEMS = ("p1", "p2", "p3", "p4", "p6", "p7", "p8", "p9", "p10")


def _modules():
    return [importlib.import_module(f"trellium.llm.problems.{p}") for p in _PROBLEMS]


def queries():
    return {k: f for m in _modules() for k, f in m.queries().items()}


def sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.sql().items()}
