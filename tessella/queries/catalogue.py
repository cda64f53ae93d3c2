"""Every query of the library outside ``llm``, and its SQL."""

from __future__ import annotations

from tessella.queries import knowledge, library, problems, store

_MODULES = (problems, store, knowledge, library)


def queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def sql() -> dict:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
