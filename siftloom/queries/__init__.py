"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from . import analytics, insight, records, state, stored, texts, vectors

_MODULES = (texts, vectors, analytics, state, insight, stored, records)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
