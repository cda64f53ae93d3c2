"""Checks that raise before anything is planned or read."""

from __future__ import annotations

NODE_TYPES = ("PERSON", "ANIMAL", "PLACE", "ORG", "CONCEPT", "OBJECT", "EVENT")
EDGE_STATUSES = ("accepted", "proposed", "rejected")
TENANT = "tenant"


def need_text(value: str, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value


def need_status(value: str) -> str:
    if value not in EDGE_STATUSES:
        raise ValueError(f"{value!r} is no edge status")
    return value


def need_limit(value: int) -> int:
    return max(0, int(value))
