"""Registry of every checked query: name -> Spark callable, name -> oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = [
    "equisel.plans.catalog_metrics",
    "equisel.plans.catalog_prep",
    "equisel.plans.catalog_trials",
    "equisel.plans.catalog_models",
    "equisel.plans.catalog_streaming",
]


def _load():
    q, s = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        q.update(mod.QUERIES)
        s.update({k: v for k, v in mod.SQL.items() if v is not None})
    return q, s


def queries() -> dict:
    return _load()[0]


def oracle_sql() -> dict:
    return _load()[1]
