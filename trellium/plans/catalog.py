"""All queries of the core, and their SQL."""

from __future__ import annotations

from trellium.plans import frontier, keyed, memory, orphans, postings, prompts, stores, texts, urls

_MODULES = (memory, keyed, frontier, urls, texts, prompts, postings, stores, orphans)


def queries():
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.sql().items()}
