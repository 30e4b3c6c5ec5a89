"""All registered queries outside ``llm`` and their SQL: each module adds its own."""

from __future__ import annotations

from importlib import import_module

MODULES = tuple(f"graphweft.queries.{m}" for m in ("general", "language", "writes", "engine", "more"))


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(m).queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(m).oracle_sql().items()}
