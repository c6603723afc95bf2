"""Registered queries: each plan module has QUERIES (name -> function) and ORACLE (name -> DuckDB SQL)."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
