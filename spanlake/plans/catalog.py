"""Registry of every operator query (Spark) and its oracle SQL."""

from __future__ import annotations

import importlib

_SECTIONS = ["q_sources", "q_joins", "q_aggregates", "q_windows", "q_scalar", "q_inference", "q_checks"]


def _mods():
    out = []
    for name in _SECTIONS:
        try:
            out.append(importlib.import_module(f"spanlake.plans.{name}"))
        except ModuleNotFoundError as e:
            if e.name != f"spanlake.plans.{name}":
                raise
    return out


def all_queries():
    q = {}
    for m in _mods():
        q.update(m.QUERIES)
    return q


def all_sql():
    s = {}
    for m in _mods():
        s.update(m.SQL)
    return s
