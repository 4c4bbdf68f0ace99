"""The registered queries."""

from __future__ import annotations

import importlib

from lodestone.plans.registry import QUERIES, SQL, Query

MODULES = ["scans", "contents", "texts", "events", "trials", "vectors", "policy", "policies", "sessions", "sources", "gates", "media", "streams", "dialogue", "campaign"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"lodestone.plans.{m}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
